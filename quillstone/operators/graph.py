"""Connected components of a link table, as joins and grouped minima that Spark shuffles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import written

#: Links to a task where a round is written, at most; fewer tasks than the session's shuffles have are enough for few links.
TASK_LINKS = 100_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the smallest node of the neighbourhood; no more rows than links."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least.hint("merge"), "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(down: DataFrame) -> DataFrame:
    """Hang every smaller neighbour of a node, and the node, on the smallest of them; b is the smaller node of every link."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = F.array(F.struct("a", F.col("m").alias("b")), F.when(F.col("b") != F.col("m"), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
    return down.join(least.hint("merge"), "a").select(F.inline(F.filter(hung, lambda x: x.isNotNull()))).distinct()


def _settled(edges: DataFrame) -> tuple[int, bool]:
    """How many links there are, and whether each node hangs on one other that itself hangs on none."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, unsettled = nodes.agg(F.sum("up"), F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()
    return n or 0, not unsettled


def stars(edges: DataFrame, rounds: int = 40, stored: bool = False) -> DataFrame:
    """``edges(a, b)`` of longs -> ``(a, b)`` where b is the smallest node of a's component and a is any other node of it.

    Alternates the two star steps until only stars are left, which one grouping of the nodes tells. Each round is written to
    the shared folder, so the lineage stays short; minima are pre-aggregated in the map tasks and a hot node's join is
    split by AQE. ``stored``: the links are distinct rows of written tables, so they are not written once more.
    """
    edges = edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = edges if stored else written(edges.distinct(), "edges")
    least = edges.sparkSession.sparkContext.defaultParallelism
    for _ in range(rounds):
        n, settled = _settled(edges)
        if settled:
            return edges
        edges = written(_small_star(_large_star(edges)).coalesce(max(least, n // TASK_LINKS + 1)), "stars")
    if _settled(edges)[1]:
        return edges
    raise RuntimeError(f"the components did not settle in {rounds} rounds")
