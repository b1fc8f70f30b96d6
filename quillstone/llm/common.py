"""Shared helpers of the training-data operators: scratch tables, folds, bounded samples, text slices."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path, written  # noqa: F401  the operators take them from here

#: A word is a run of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Texts are handed to numpy in slices of about this many characters, so a worker's memory does not follow the batch.
SLICE_CHARS = 500_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """What is run inside hands whole texts to Python workers ``rows`` at a time, so that neither they nor the executor's
    Arrow buffers hold many at once. The session's own setting comes back after it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_arrow() -> None:
    """Hand memory that Arrow no longer uses back to the system: a worker keeps its pool from task to task (135 MB of it
    after 20,000 tokenized texts, 7 MB when released)."""
    pa.default_memory_pool().release_unused()


def fold(doc_id: Column, k: int) -> Column:
    """crc32 of the id as text, modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(k)


def one_label(labels: DataFrame, column: str) -> DataFrame:
    """One row per labelled id. Repeated rows with different labels take the largest."""
    return (
        labels.select("doc_id", F.col(column).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )


def bounded_ids(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, picked by a hash of the id, so the pick does not depend on the partitions.

    Rows are counted per label first, and only those whose hash lies under a threshold that leaves about a fifth more
    than ``per_label`` are ranked, so a common label does not send its rows to one task. Labels must be few.
    """
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40))
    near = rows.join(counts.hint("broadcast"), label).filter(place < F.lit(1.2 * per_label + 200) / F.col("_n") * F.lit(float(1 << 40)))
    order = Window.partitionBy(label).orderBy(place, F.col("doc_id"))
    return near.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= per_label).drop("_rank", "_n")


def strings(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Python strings of an Arrow column; null becomes the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def pieces(text: str, most: int = SLICE_CHARS) -> Iterator[str]:
    """Cut a very long text at white space into pieces of at most ``most`` characters.

    Only a single word that is longer than ``most`` is cut inside.
    """
    at, n = 0, len(text)
    while n - at > most:
        end = max(text.rfind(" ", at, at + most), text.rfind("\n", at, at + most))
        end = end if end > at else at + most
        yield text[at:end]
        at = end
    yield text[at:]


def slices(texts: list[str], most: int = SLICE_CHARS, rows: int = 10_000) -> Iterator[tuple[list[int], list[str]]]:
    """Groups of (row numbers, pieces) of about ``most`` characters; a long text spreads over several groups."""
    at: list[int] = []
    part: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for piece in pieces(text, most) if len(text) > most else (text,):
            if part and (size + len(piece) > most or len(part) >= rows):
                yield at, part
                at, part, size = [], [], 0
            at.append(i)
            part.append(piece)
            size += len(piece) + 1
    if part:
        yield at, part


def code_points(part: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the pieces, each between spaces, and for each code point the number of its piece."""
    joined = " " + " ".join(part) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter((len(x) + 1 for x in part), dtype=np.int64, count=len(part))
    lengths[0] += 1
    return codes, np.repeat(np.arange(len(part), dtype=np.int64), lengths)


def mix(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """A bucket of ``bits`` bits for every unsigned 64-bit value."""
    x = (x ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - bits)).astype(np.int64)


_POWERS = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(64)], dtype=np.uint64)


def word_hashes(codes: np.ndarray, owner: np.ndarray, inside: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hashes of the runs where ``inside`` holds, the piece of each run, and for each length in ``prefixes`` which runs are
    longer and the hashes of their beginnings.

    Positions above 63 of a run reuse the powers in turn, so very long words are still read whole.
    """
    where = np.flatnonzero(inside)
    if not len(where):
        none = np.empty(0, dtype=np.uint64)
        return none, np.empty(0, dtype=np.int64), [(none.astype(bool), none) for _ in prefixes]
    first = np.flatnonzero(np.diff(where, prepend=-2) != 1)
    start, length = where[first], np.diff(first, append=len(where))
    run = np.repeat(np.arange(len(first)), length)
    part = (codes[where].astype(np.uint64) + np.uint64(1)) * _POWERS[(where - start[run]) & 63]
    begun = []
    for n in prefixes:
        longer = length > n
        sums = part[first[longer]].copy()
        for k in range(1, n):
            sums += part[first[longer] + k]
        begun.append((longer, sums))
    return np.add.reduceat(part, first), owner[start], begun


def letters_or_digits(codes: np.ndarray) -> np.ndarray:
    """True for ASCII letters and digits and for code points from U+00C0 that are not general punctuation."""
    low = np.zeros(0x100, dtype=bool)
    low[48:58] = low[65:91] = low[97:123] = True
    low[0xC0:0x100] = True
    low[[0xD7, 0xF7]] = False
    wide = codes >= 0x100
    out = low[np.where(wide, 0, codes)]
    return out | (wide & ~((codes >= 0x2000) & (codes < 0x2070)) & ~((codes >= 0x3000) & (codes < 0x3040)))
