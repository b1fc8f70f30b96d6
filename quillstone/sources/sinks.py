"""Sinks (A10-A11): result and status documents, Markdown and bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _list(c: str, kind: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast(kind)).alias(c)


def result_json(reports: DataFrame) -> DataFrame:
    """A10: ``(topic_id, document)`` of completed topics; missing collections are empty arrays."""
    kinds = dict(reports.dtypes)
    arrays = [_list(c, kinds[c]) for c in ("papers", "gaps", "directions") if c in kinds]
    rest = [F.col(c) for c in reports.columns if c not in ("papers", "gaps", "directions")]
    return reports.filter("status = 'completed'").select("topic_id", F.to_json(F.struct(*rest, *arrays), {"ignoreNullFields": "false"}).alias("document"))


def status_json(topics: DataFrame) -> DataFrame:
    """A10: the light status document of every topic (topic_id, run_id, status, current_stage, progress, error_message); an empty
    error is left out."""
    error = F.when(F.coalesce("error_message", F.lit("")) != "", F.col("error_message")).alias("error")
    return topics.select("topic_id", F.to_json(F.struct("topic_id", "run_id", "status", F.col("current_stage").alias("stage"), "progress", error)).alias("document"))


def refused(topics: DataFrame) -> DataFrame:
    """Topics whose artefacts may not be written yet."""
    return topics.filter("status != 'completed'").select("topic_id", F.concat(F.lit("topic is "), "status").alias("reason"))


def write_text(reports: DataFrame, column: str, path: str, compression: str = "none") -> None:
    """One folder per completed topic; lines of the artefact in order."""
    rows = reports.filter("status = 'completed'").select("topic_id", F.col(column).alias("value"))
    rows.repartition("topic_id").write.partitionBy("topic_id").option("compression", compression).option("lineSep", "\n\f\n").text(path)
