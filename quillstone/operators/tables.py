"""Keyed upserts, deletes, table rules and versioned tables.

An upsert is a new table version from the old one and a delta: a full outer join on the key with one rule per column.
Rows of a delta with the same key are applied in order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import author_key, content_hash, normalize_title, null_if_empty, strip_space

#: A column's rule gets the old and the new value and whether an old row and a new row exist.
Rule = Callable[[Column, Column, Column, Column], Column]


def overwrite(old: Column, new: Column, was: Column, has: Column) -> Column:
    """The new row's value, null included; the old one where there is no new row."""
    return F.when(has, new).otherwise(old)


def keep_old(old: Column, new: Column, was: Column, has: Column) -> Column:
    return F.when(was, old).otherwise(new)


#: The column of a delta that holds the order of its rows.
ORDER = "ordinal"


def _order(delta: DataFrame, order: str) -> Column:
    ties = F.xxhash64(*[F.col(f"`{c}`") for c in delta.columns])
    return F.struct(F.col(f"`{order}`"), ties) if order in delta.columns else F.struct(ties)


def _unordered(n: Column) -> Column:
    return F.when(n > 1, F.raise_error(F.lit(f"a key repeats in a delta without the column {ORDER}")).cast("int")).otherwise(F.lit(1))


def last_per_key(delta: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """The last row of each key by ``order``, a null of which is first; rows equal in it go by a hash. Without that column a key must not
    repeat."""
    per_key = Window.partitionBy(*keys)
    n = F.row_number().over(per_key.orderBy(_order(delta, order).desc())) if order in delta.columns else _unordered(F.count("*").over(per_key))
    return delta.withColumn("_n", n).filter("_n = 1").drop("_n")


def applied(delta: DataFrame, keys: list[str], order: str = ORDER) -> DataFrame:
    """``(keys, first, last, varied, _has)``: the first and the last row of each key and, for each column, whether it changed in
    between. Rows are aggregated in the map tasks, so a hot key is not gathered."""
    row = F.struct(*[F.col(f"`{c}`") for c in delta.columns if c not in keys])
    at = _order(delta, order)
    varied = F.struct(*[(F.min(F.xxhash64(f"`{c}`")) != F.max(F.xxhash64(f"`{c}`"))).alias(c) for c in delta.columns if c not in keys])
    made = delta.groupBy(*keys).agg(F.min_by(row, at).alias("first"), F.max_by(row, at).alias("last"), varied.alias("varied"), F.count("*").alias("_rows"))
    return made.withColumn("_has", F.lit(True) if order in delta.columns else _unordered(F.col("_rows")) == 1).drop("_rows")


def upsert(old: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, Rule], default: Rule = overwrite) -> DataFrame:
    """Old rows, changed and new rows, as if the rows of ``delta`` came one by one in the order of ``ordinal``: a new key takes what is
    only inserted from its first row and what is overwritten from its last. That column is not stored unless ``old`` has it."""
    left = old.withColumn("_was", F.lit(True)).alias("o")
    right = applied(delta, keys).alias("d")
    on = [F.col(f"o.{k}") == F.col(f"d.{k}") for k in keys]
    joined = left.join(right, on, "full_outer")
    was, has = F.coalesce(F.col("o._was"), F.lit(False)), F.coalesce(F.col("d._has"), F.lit(False))
    out = [F.coalesce(f"o.{k}", f"d.{k}").alias(k) for k in keys]
    for c in old.columns:
        if c not in keys:
            rule = rules.get(c, default if c in delta.columns else keep_old)
            new = F.col(f"d.{'first' if rule is keep_old else 'last'}.{c}") if c in delta.columns else F.lit(None)
            out.append(rule(F.col(f"o.{c}"), new, was, has).alias(c))
    return joined.select(*out).select(*old.columns)


def upsert_papers(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Key (source, external_id); everything but id and created_at is overwritten, by null too."""
    return upsert(old, delta, ["source", "external_id"], {"id": keep_old, "created_at": keep_old})


def upsert_memberships(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Only the discovery source changes; score and analysis stay."""
    return upsert(old, delta, ["topic_id", "paper_id"], {"discovery_source": overwrite}, default=keep_old)


def upsert_authors(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Authors with an id go by it, the rest by their lower-case trimmed name; names are overwritten."""
    ident = lambda df: df.filter("author_id IS NOT NULL")
    named = lambda df: df.filter("author_id IS NULL").withColumn("key", author_key(F.col("name")))
    by_id = upsert(ident(old), ident(delta), ["author_id"], {})
    by_name = upsert(named(old), named(delta), ["key"], {}).drop("key")
    return by_id.unionByName(by_name.select(*by_id.columns))


def link_authors(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Append authors after the last position of their paper. Blank and repeated names are skipped; a link that
    exists is not added again but still uses up a position."""
    named = incoming.withColumn("key", normalize_title(F.col("name"))).filter("key != ''")
    first = named.withColumn("_n", F.row_number().over(Window.partitionBy("paper_id", "key").orderBy("ordinal"))).filter("_n = 1")
    placed = first.withColumn("_k", F.row_number().over(Window.partitionBy("paper_id").orderBy("ordinal")) - 1)
    last = links.groupBy("paper_id").agg((F.max("position") + 1).alias("_next"))
    new = placed.join(last, "paper_id", "left").select("paper_id", "author_id", (F.coalesce("_next", F.lit(0)) + F.col("_k")).cast("int").alias("position"))
    return links.unionByName(new.join(links.select("paper_id", "author_id"), ["paper_id", "author_id"], "left_anti"))


#: What a changed chunk loses.
EMBEDDING = ["embedded_content_hash", "embedding_provider", "embedding_model", "embedding_dimensions", "instruction_version", "indexing_version", "qdrant_collection", "qdrant_point_id", "error_message"]


def upsert_chunks(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Key (topic, paper, type, index). A hash that never changed keeps status and embedding, else they are reset, even if the
    last row has the old hash again."""
    same = F.col("o.content_hash").eqNullSafe(F.col("d.first.content_hash")) & ~F.col("d.varied.content_hash")
    reset = lambda value: lambda old, new, was, has: F.when(has & ~(was & same), F.lit(value)).otherwise(old)
    rules = {c: reset(None) for c in EMBEDDING if c in old.columns} | {"embedding_status": reset("pending"), "id": keep_old}
    return upsert(old, delta, ["topic_id", "paper_id", "chunk_type", "chunk_index"], rules)


def delete_stale_chunks(chunks: DataFrame, kept: DataFrame) -> DataFrame:
    """Without chunks at or beyond the new count of their (topic, paper, type)."""
    joined = chunks.join(kept.select("topic_id", "paper_id", "chunk_type", "n"), ["topic_id", "paper_id", "chunk_type"], "left")
    return joined.filter("n IS NULL OR chunk_index < n").select(*chunks.columns)


def delete_topic_papers(papers: DataFrame, memberships: DataFrame, topics: DataFrame, keep_orphans: bool = False) -> tuple[DataFrame, DataFrame]:
    """(papers, memberships) without these topics' memberships and then without papers that no topic has."""
    left = memberships.join(topics, "topic_id", "left_anti")
    return (papers if keep_orphans else papers.join(left.select("paper_id"), "paper_id", "left_semi")), left


def delete_topics(tables: dict[str, DataFrame], topics: DataFrame) -> dict[str, DataFrame]:
    """Every table that has topic_id loses the topics' rows; references to lost gaps become null."""
    out = {name: t.join(topics, "topic_id", "left_anti") if "topic_id" in t.columns else t for name, t in tables.items()}
    if "directions" in out and "gaps" in out:
        gaps = out["gaps"].select(F.col("id").alias("gap_id"), F.lit(True).alias("_there"))
        cols = out["directions"].columns
        joined = out["directions"].join(gaps, "gap_id", "left").withColumn("gap_id", F.when(F.col("_there"), F.col("gap_id")))
        out["directions"] = joined.select(*cols)
    return out


def upsert_titled(old: DataFrame, delta: DataFrame) -> DataFrame:
    """Gaps and directions, by (topic, title)."""
    return upsert(old, delta, ["topic_id", "title"], {"id": keep_old, "created_at": keep_old})


def upsert_documents(old: DataFrame, delta: DataFrame) -> DataFrame:
    """D11."""
    return upsert(old, delta, ["paper_id"], {})


def upsert_cleanup_tasks(old: DataFrame, delta: DataFrame) -> DataFrame:
    """A completed task stays completed, any other goes back to pending; the error is cleared."""
    status = lambda o, n, was, has: F.when(has & F.coalesce(o != "completed", F.lit(True)), "pending").otherwise(o)
    clear = lambda o, n, was, has: F.when(~has, o)
    return upsert(old, delta, ["collection_name", "point_id"], {"status": status, "error_message": clear, "attempts": lambda o, n, was, has: F.coalesce(o, F.lit(0))})


def start_stages(old: DataFrame, started: DataFrame) -> DataFrame:
    """A new (run, stage) has attempt 1; every other start, within ``started`` too, adds one and resets times and error. Without
    ``ordinal`` the largest time counts."""
    last = (lambda c: F.max_by(c, ORDER)) if ORDER in started.columns else F.max
    started = started.groupBy("run_id", "stage").agg(F.count("*").alias("attempt"), *[last(c).alias(c) for c in started.columns if c not in ("run_id", "stage", "attempt", ORDER)])
    rules: dict[str, Rule] = {
        "attempt": lambda o, n, was, has: F.when(has, F.coalesce(o, F.lit(0)) + n).otherwise(o).cast("int"),
        "status": lambda o, n, was, has: F.when(has, "running").otherwise(o),
        "completed_at": lambda o, n, was, has: F.when(~has, o),
        "error_message": lambda o, n, was, has: F.when(~has, o),
    }
    return upsert(old, started, ["run_id", "stage"], rules)


def update_topics(topics: DataFrame, delta: DataFrame) -> DataFrame:
    """New status, stage, progress and error, of a topic's changes the last; completed_at is set only once, by the
    first change that completes. Unknown topics are not added."""
    cols = topics.columns
    first = F.min(F.when(F.col("status") == "completed", F.col("at"))).over(Window.partitionBy("topic_id"))
    delta = last_per_key(delta.withColumn("_at", first), ["topic_id"])
    d = delta.select("topic_id", *[F.col(c).alias(f"_{c}") for c in ("status", "current_stage", "progress", "error_message")], "_at", F.lit(True).alias("_has"))
    j = topics.join(d, "topic_id", "left")
    for c in ("status", "current_stage", "progress", "error_message"):
        j = j.withColumn(c, F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)))
    return j.withColumn("completed_at", F.coalesce("completed_at", "_at")).select(*cols)


def update_columns(old: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Set columns of existing rows, by the last change of each; rows without a delta keep theirs."""
    d = last_per_key(delta, keys).select(*keys, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_has"))
    j = old.join(d, keys, "left")
    return j.select(*[F.when(F.col("_has"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in old.columns])


#: The columns of a chunk that hold the identity of its vector, in the order of the identity.
IDENTITY_COLUMNS = {"provider": "embedding_provider", "model": "embedding_model", "dimensions": "embedding_dimensions", "instruction_version": "instruction_version", "indexing_version": "indexing_version"}


def _transition(chunks: DataFrame, picked: DataFrame, when: Column, changes: dict[str, Column]) -> DataFrame:
    """``chunks`` with ``changes`` where a row of ``picked(id, …)`` is there (as ``p``) and ``when`` holds."""
    j = chunks.alias("c").join(picked.withColumn("_hit", F.lit(True)).alias("p").hint("merge"), F.col("c.id") == F.col("p.id"), "left")
    hit = F.coalesce(F.col("p._hit") & when, F.lit(False))
    return j.select(*[F.when(hit, changes[c]).otherwise(F.col(f"c.{c}")).alias(c) if c in changes else F.col(f"c.{c}") for c in chunks.columns])


def _identity_changes(identity: dict[str, object], collection: str) -> dict[str, Column]:
    return {c: F.lit(identity[k]) for k, c in IDENTITY_COLUMNS.items() if k in identity} | {"qdrant_collection": F.lit(collection), "qdrant_point_id": F.col("p.point_id"), "error_message": F.lit(None).cast("string")}


def start_embedding(chunks: DataFrame, picked: DataFrame, identity: dict[str, object], collection: str) -> DataFrame:
    """Chunks of ``picked(id, point_id)`` to ``indexing``, with the identity, collection and point their vector will have; a
    former error is cleared."""
    return _transition(chunks, picked, F.lit(True), {"embedding_status": F.lit("indexing")} | _identity_changes(identity, collection))


def finish_embedding(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """To ``completed`` only where the point is still the chunk's; the embedded hash becomes the content's."""
    done = {"embedding_status": F.lit("completed"), "embedded_content_hash": F.col("c.content_hash"), "error_message": F.lit(None).cast("string")}
    return _transition(chunks, stored, F.col("p.point_id") == F.col("c.qdrant_point_id"), done)


def activate_generation(chunks: DataFrame, points: DataFrame, identity: dict[str, object], collection: str) -> DataFrame:
    """Chunks whose content is still what the new generation embedded (``points(id, point_id, content_hash)``) move to
    it, whatever their state; others are left for the next run."""
    done = {"embedding_status": F.lit("completed"), "embedded_content_hash": F.col("c.content_hash")} | _identity_changes(identity, collection)
    return _transition(chunks, points, F.col("p.content_hash") == F.col("c.content_hash"), done)


def backfill_memberships(legacy: DataFrame, memberships: DataFrame) -> DataFrame:
    """Memberships from legacy paper rows, where absent."""
    made = legacy.select("topic_id", "paper_id", F.col("source").alias("discovery_source"), F.when(F.col("analysis").isNull(), "pending").otherwise("completed").alias("analysis_status"))
    return made.join(memberships, ["topic_id", "paper_id"], "left_anti")


def backfill_abstract_chunks(papers: DataFrame, memberships: DataFrame, chunks: DataFrame) -> DataFrame:
    """An abstract chunk per membership whose paper has one, where absent."""
    rows = memberships.select("topic_id", "paper_id").join(papers.select("paper_id", "abstract"), "paper_id")
    rows = rows.filter(strip_space(F.coalesce("abstract", F.lit(""))) != "")
    made = rows.select("topic_id", "paper_id", F.lit("abstract").alias("chunk_type"), F.lit(0).alias("chunk_index"), F.col("abstract").alias("text"), content_hash(F.col("abstract")).alias("content_hash"))
    return made.join(chunks, ["topic_id", "paper_id", "chunk_type", "chunk_index"], "left_anti")


def remap_status(rows: DataFrame, mapping: dict[str, str], default_error: str, failed: str = "failed") -> DataFrame:
    """Old status names to new ones; failures without an error get the default one."""
    out = rows.replace(mapping, subset=["status"])
    return out.withColumn("error_message", F.when((F.col("status") == failed) & null_if_empty(F.col("error_message")).isNull(), default_error).otherwise(F.col("error_message")))


def violations(rows: DataFrame, name: str, key: str, checks: dict[str, Column], unique: dict[str, list[str]] | None = None, references: dict[str, tuple[str, DataFrame, str]] | None = None) -> DataFrame:
    """``(table_name, rule, key)`` of each broken rule: predicates, uniqueness, and references to other tables."""
    fired = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(rule)) for rule, ok in checks.items()]), lambda x: x.isNotNull())
    out = rows.select(F.lit(name).alias("table_name"), F.explode(fired).alias("rule"), F.col(key).cast("string").alias("key"))
    for rule, cols in (unique or {}).items():
        twice = rows.dropna(subset=cols).groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
        out = out.unionByName(twice.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.concat_ws("|", *cols).alias("key")))
    for rule, (column, other, other_key) in (references or {}).items():
        lost = rows.filter(F.col(column).isNotNull()).join(other.select(F.col(other_key).alias(column)), column, "left_anti")
        out = out.unionByName(lost.select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key")))
    return out


def stamp_updated(new: DataFrame, old: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """Rows that are new or differ from the old version get ``updated_at``."""
    body = [c for c in new.columns if c not in (*keys, "updated_at")]
    mark = lambda df, n: df.select(*keys, F.xxhash64(*body).alias(n))
    j = new.join(mark(old, "_h"), keys, "left")
    return j.withColumn("updated_at", F.when(F.col("_h").eqNullSafe(F.xxhash64(*body)), F.col("updated_at")).otherwise(now)).select(*new.columns)


def new_topics(requests: DataFrame) -> DataFrame:
    """Topic rows with defaults; expanded queries as JSON."""
    return requests.select("topic_id", "topic", F.to_json("queries").alias("expanded_queries"), F.lit("pending").alias("status"), F.lit("pending").alias("current_stage"), F.lit(0.0).alias("progress"))


class TableStore:
    """Versioned Parquet tables: a version is written whole, then a pointer row names it.

    The pointer is a one-row Parquet directory per commit, so a commit is one directory that appears at once; the highest
    committed number is the current version. Versions are never overwritten, so readers are not disturbed.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _commits(self, name: str) -> list[tuple[int, str]]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_commits")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted((int(n.split("-")[0]), n.split("-", 1)[1]) for n in (s.getPath().getName() for s in fs.listStatus(path)) if n[0].isdigit())

    def commit(self, name: str, df: DataFrame) -> int:
        """Write a new version; fails if another writer took its number."""
        done = self._commits(name)
        version, tag = (done[-1][0] + 1 if done else 1), uuid.uuid4().hex
        df.write.parquet(f"{self.root}/{name}/v={version}-{tag}")
        jvm = self.spark._jvm
        mark = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/_commits/{version:012d}-{tag}")
        fs = mark.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if [v for v, _ in self._commits(name) if v >= version]:
            raise RuntimeError(f"{name}: version {version} was committed by another writer")
        fs.mkdirs(mark)
        return version

    def read(self, name: str, version: int | None = None) -> DataFrame:
        found = dict(self._commits(name))
        if not found:
            raise ValueError(f"{name} has no version")
        number = version or max(found)
        return self.spark.read.parquet(f"{self.root}/{name}/v={number}-{found[number]}")
