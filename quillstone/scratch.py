"""Scratch tables in the shared folder: they cut lineage and survive lost executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder of ``spark.checkpoint.dir``; only where that is unset (tests), a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        app = spark.sparkContext.applicationId
        base = _LOCAL.setdefault(app, tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR")))
    return f"{base.rstrip('/')}/quillstone-{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str, by: str | None = None, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: later steps do not recompute it and survive lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    out = df.write.option("compression", compression)
    if by:
        out = out.partitionBy(by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
