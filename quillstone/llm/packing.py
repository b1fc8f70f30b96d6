"""Operator 7: best-fit decreasing packing of token pieces into fixed-length sequences.

Open sequences are held by their remaining capacity, and a segment tree over the capacities 0…``capacity`` finds the
smallest one that still takes a piece in logarithmic time.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release_arrow, small_batches, table, written
from .tokens import default_tokenizer, encoder

#: (rows of a batch, characters that a worker tokenizes at once, words that it remembers): more take less time and more
#: memory, about a quarter less and some 200 MB a worker more.
WIDE, LEAN = (10_000, 8_000_000, 800_000), (1_000, 500_000, 100_000)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OpenBins:
    """Open bins by remaining capacity, with a segment tree that counts the bins below each node."""

    def __init__(self, capacity: int) -> None:
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, remaining: int, bin_id: int) -> None:
        self.bins[remaining].append(bin_id)
        self._add(remaining, 1)

    def _add(self, remaining: int, n: int) -> None:
        i = remaining + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """(bin, remaining) of an open bin with the smallest remaining capacity of at least ``length``; it is taken out."""
        count, i = self.count, length + self.leaves
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        remaining = i - self.leaves
        self._add(remaining, -1)
        return self.bins[remaining].pop(), remaining


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; ``lengths`` must already be in descending order."""
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bins, used = OpenBins(capacity), 0
    for k, n in enumerate(lengths):
        found = bins.tightest(n) if n < capacity else None
        if found is None:
            found, used = (used, capacity), used + 1
        where[k], remaining = found
        offset[k] = capacity - remaining
        if remaining > n:
            bins.put(remaining - n, int(where[k]))
    return where, offset


def token_pieces(docs: DataFrame, capacity: int, tokenizer: str, end_id: int, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Cut each document's ids (with the end id) into pieces of ``capacity``; ``with_ids`` adds the ids as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, slice_chars, cache_words = LEAN if lean else WIDE
        enc, end, width = encoder(tokenizer, cache_words), struct.pack("<I", end_id), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            flat, counts = enc.batch(batch.column(1).to_pylist(), slice_chars)
            flat, upto = memoryview(flat.astype("<u4", copy=False)).cast("B"), 0
            for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist(), strict=True):
                ids = bytes(flat[upto : upto + 4 * n]) + end
                upto += 4 * n
                for piece, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, kinds, strict=False)], [name for name, _ in kinds])
            del batch, flat
            if lean:
                release_arrow()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, group_pieces: int = 100_000, with_ids: bool = False, lean: bool = False) -> DataFrame:
    """``docs(doc_id, text, …)`` -> one row per piece with its ``sequence_id`` and ``offset``.

    Pieces are dealt by hash into groups of about ``group_pieces`` (their sizes, not their texts, so a group is a few
    MB), each packed by best-fit decreasing on its own: tasks stay bounded and a group's only loss is its last open
    sequences. Null and empty texts are one end id. Repeated ids are packed row by row, a null id too. Ties in length
    are taken in the order of doc_id and piece. An empty table gives no rows; other columns are ignored.
    ``lean`` tokenizes in less memory and more time, with the same result: for executors that other stages have filled.
    """
    with small_batches(docs.sparkSession, (LEAN if lean else WIDE)[0]):
        made = written(token_pieces(docs, capacity, tokenizer or default_tokenizer(), end_id, with_ids, lean), "pieces")
    groups = max(1, -(-made.count() // group_pieces))

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(frame["length"].tolist(), capacity)
        return frame.drop(columns="part").assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)

    dealt = made.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)).cast("int"))
    return dealt.groupBy("part").applyInPandas(run, PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
