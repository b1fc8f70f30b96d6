"""Operator 9: token ids in binary files coded by a static range asymmetric numeral system.

File format (all integers little-endian):

* ``table.qrt``: magic ``QRT1``, u32 symbols, u32 scale bits, u32 frequency of every id, u32 crc32 of the frequencies.
* data file: magic ``QRA1``, u32 crc32 of the table; then blocks; then per block u64 position, u64 first token; u32 number
  of blocks, magic ``QRAE``.
* block: magic ``QRB1``, u64 start (ids of all documents before it), u32 documents, u32 tokens, u32 lanes, u32 checkpoints,
  u32 words, u32 bytes of the doc table, u32 crc32 of the rest; the doc table (i64 doc_id or -2^63 for null, u32 tokens);
  checkpoints (u32 row, u32 word, u64 state per lane); u32 words.

Ids of a block lie row by row on ``lanes`` interleaved coders with 64-bit states that move 32-bit words. All files share
the frequencies. A block decodes alone, and from each of its checkpoints alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files
from .common import scratch_path, table, written
from .tokens import default_tokenizer, encoder

SCALE = 20
LOW = np.uint64(1 << 31)
BLOCK_TOKENS = 1 << 19
CHECKPOINT_ROWS = 128
_NO_ID = -(1 << 63)
_HEAD = struct.Struct("<4sQIIIIIII")


class Table:
    """Frequencies scaled to 2**SCALE with at least one for every id, and what coding needs of them."""

    def __init__(self, freq: np.ndarray) -> None:
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64)
        assert int(self.freq.sum()) == 1 << SCALE, "frequencies must fill the scale"
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol

    @classmethod
    def of_counts(cls, counts: np.ndarray) -> Table:
        """Counts over the corpus -> frequencies; what rounding leaves goes to the commonest ids."""
        room = (1 << SCALE) - len(counts)
        if room < 0:
            raise ValueError(f"{len(counts)} ids do not fit a scale of 2**{SCALE}")
        total = max(1, int(counts.sum()))
        freq = 1 + (counts.astype(object) * room // total).astype(np.int64)
        order = np.argsort(-counts, kind="stable")
        left = (1 << SCALE) - int(freq.sum())
        freq += left // len(freq)
        freq[order[: left % len(freq)]] += 1
        return cls(freq)

    def to_bytes(self) -> bytes:
        body = self.freq.astype("<u4").tobytes()
        return struct.pack("<4sII", b"QRT1", len(self.freq), SCALE) + body + struct.pack("<I", self.crc)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        magic, n, scale = struct.unpack_from("<4sII", raw)
        out = cls(np.frombuffer(raw, "<u4", n, 12))
        if magic != b"QRT1" or scale != SCALE or out.crc != struct.unpack_from("<I", raw, 12 + 4 * n)[0]:
            raise ValueError("not a whole frequency table")
        return out


def encode_ids(ids: np.ndarray, t: Table) -> tuple[int, list[tuple[int, int, np.ndarray]], np.ndarray]:
    """(lanes, checkpoints (row, word, states), words). Rows are coded from the last to the first."""
    n = len(ids)
    lanes = int(min(2048, max(1, n // 64)))
    rows = -(-n // lanes)
    x = np.full(lanes, LOW, dtype=np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    emitted = 0
    scale, half, mask = np.uint64(SCALE), np.uint64(32), np.uint64(0xFFFFFFFF)
    freq, first = t.freq[ids], t.first[ids]
    for row in range(rows - 1, -1, -1):
        f, c = freq[row * lanes : (row + 1) * lanes], first[row * lanes : (row + 1) * lanes]
        own = x[: len(f)]
        over = own >= f << np.uint64(63 - SCALE)
        if over.any():
            words.append((own[over] & mask).astype("<u4"))
            emitted += len(words[-1])
            own = np.where(over, own >> half, own)
        q, r = np.divmod(own, f)
        x[: len(f)] = (q << scale) + r + c
        if row % CHECKPOINT_ROWS == 0:
            marks.append((row, emitted, x.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, dtype="<u4")
    return lanes, [(row, emitted - at, state) for row, at, state in reversed(marks)], stream


def decode_ids(n: int, lanes: int, marks: list[tuple[int, int, np.ndarray]], words: np.ndarray, t: Table, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids from checkpoint ``start`` up to checkpoint ``stop`` (the block's end if None)."""
    row, at, state = marks[start]
    x, rows = state.copy(), marks[stop][0] if stop is not None else -(-n // lanes)
    out = np.empty(min(n, rows * lanes) - row * lanes, dtype=np.uint32)
    scale, low, half = np.uint64(SCALE), np.uint64((1 << SCALE) - 1), np.uint64(32)
    symbol, freq, first, base = t.symbol, t.freq, t.first, row * lanes
    for k in range(row, rows):
        here = min(lanes, n - k * lanes)
        own = x[:here]
        slot = own & low
        s = symbol[slot.astype(np.int64)]
        out[k * lanes - base : k * lanes - base + here] = s
        own = freq[s] * (own >> scale) + slot - first[s]
        under = np.flatnonzero(own < LOW)
        if len(under):
            own[under] = (own[under] << half) | words[at : at + len(under)]
            at += len(under)
        x[:here] = own
    return out


@dataclass
class Block:
    start: int
    doc_ids: list[int | None]
    lengths: np.ndarray
    ids: np.ndarray


def block_bytes(block: Block, t: Table) -> bytes:
    lanes, marks, words = encode_ids(block.ids, t)
    docs = np.array([_NO_ID if d is None else d for d in block.doc_ids], dtype="<i8").tobytes() + block.lengths.astype("<u4").tobytes()
    body = docs + b"".join(struct.pack("<II", row, at) + state.astype("<u8").tobytes() for row, at, state in marks) + words.astype("<u4").tobytes()
    return _HEAD.pack(b"QRB1", block.start, len(block.doc_ids), len(block.ids), lanes, len(marks), len(words), len(docs), zlib.crc32(body)) + body


@dataclass
class Stored:
    """A block as it lies in a file: its documents and what decoding needs."""

    start: int
    doc_ids: list[int | None]
    lengths: np.ndarray
    n: int
    lanes: int
    marks: list[tuple[int, int, np.ndarray]]
    words: np.ndarray

    def ids(self, t: Table, low: int = 0, high: int | None = None) -> np.ndarray:
        """The block's ids from ``low`` up to ``high``, decoded from the checkpoint before to the one after."""
        high = self.n if high is None else high
        if low >= high:
            return np.empty(0, dtype=np.uint32)
        rows = [m[0] for m in self.marks]
        first = int(np.searchsorted(rows, low // self.lanes, side="right")) - 1
        last = int(np.searchsorted(rows, -(-high // self.lanes), side="left"))
        found = decode_ids(self.n, self.lanes, self.marks, self.words, t, first, last if last < len(rows) else None)
        return found[low - rows[first] * self.lanes : high - rows[first] * self.lanes]


def read_block(read, t: Table) -> Stored:
    """``read(n)`` gives the next n bytes."""
    magic, start, n_docs, n, lanes, n_marks, n_words, docs, crc = _HEAD.unpack(read(_HEAD.size))
    body = read(docs + n_marks * (8 + 8 * lanes) + 4 * n_words)
    if magic != b"QRB1" or zlib.crc32(body) != crc:
        raise ValueError("a damaged block")
    ids = np.frombuffer(body, "<i8", n_docs)
    lengths = np.frombuffer(body, "<u4", n_docs, 8 * n_docs)
    marks, at = [], docs
    for _ in range(n_marks):
        row, word = struct.unpack_from("<II", body, at)
        marks.append((row, word, np.frombuffer(body, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(body, "<u4", n_words, at)
    return Stored(start, [None if d == _NO_ID else int(d) for d in ids], lengths, n, lanes, marks, words)


def block_index(f, t: Table) -> list[tuple[int, int]]:
    """(position, first token) of every block of an open file of this table."""
    magic, crc = struct.unpack("<4sI", f.read(8))
    f.seek(f.size() - 8)
    n, end = struct.unpack("<I4s", f.read(8))
    if magic != b"QRA1" or end != b"QRAE" or crc != t.crc:
        raise ValueError("not a whole file of this table")
    f.seek(f.size() - 8 - 16 * n)
    return list(struct.iter_unpack("<QQ", f.read(16 * n)))


def read_range(path: str, t: Table, start: int, stop: int) -> np.ndarray:
    """Ids of the places ``start`` up to ``stop`` that lie in this file. Only the blocks that the index names are read, and
    only the rows between their checkpoints decoded."""
    found = [np.empty(0, dtype=np.uint32)]
    with files.at(path) as f:
        index = block_index(f, t)
        firsts = [first for _, first in index]
        for k in range(max(0, int(np.searchsorted(firsts, start, side="right")) - 1), len(index)):
            if firsts[k] >= stop:
                break
            f.seek(index[k][0])
            b = read_block(f.read, t)
            found.append(b.ids(t, max(0, start - b.start), min(b.n, stop - b.start)))
    return np.concatenate(found)


def tokenized(docs: DataFrame, tokenizer: str, end_id: int, partitions: int) -> DataFrame:
    """Documents in ranges of doc_id, in order within a range, as 16- or 32-bit ids with the place within the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        kind = "<u2" if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], dtype=kind)
        for batch in batches:
            ids, counts = enc.batch(batch.column(1).to_pylist())
            ids, after = ids.astype(kind), np.cumsum(counts)
            rows = [np.concatenate([ids[z - n : z], end]).tobytes() for z, n in zip(after.tolist(), counts.tolist(), strict=True)]
            counts = counts + 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(at + np.cumsum(counts) - counts), pa.array(counts), pa.array(rows, pa.binary())], ["doc_id", "part", "at", "n", "ids"])
            at += int(counts.sum())

    ranged = docs.select(F.col("doc_id").cast("long"), "text").withColumn("tie", F.xxhash64("text")).repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    return ranged.drop("tie").mapInArrow(run, "doc_id long, part int, at long, n long, ids binary")


def _id_array(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def id_counts(tokens: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all documents. Tasks count on their own; the driver gets one row per id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(vocabulary, dtype=np.int64), np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        for batch in batches:
            own, column = batch.column(0), batch.column(0).buffers()
            if len(own):  # the rows' bytes lie end to end in one buffer
                ends = np.frombuffer(column[1], "<i4", len(own) + 1, 4 * own.offset)
                total += np.bincount(np.frombuffer(column[2], kind, int(ends[-1] - ends[0]) // kind.itemsize, int(ends[0])), minlength=vocabulary)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["id", "c"])

    rows = tokens.select("ids").mapInArrow(run, "id int, c long").groupBy("id").agg(F.sum("c").alias("c")).toPandas()
    counts = np.zeros(vocabulary, dtype=np.int64)
    counts[rows["id"].to_numpy(dtype=np.int64)] = rows["c"].to_numpy(dtype=np.int64)
    return counts


def write_files(tokens: DataFrame, folder: str, t: Table, offsets: dict[int, int]) -> DataFrame:
    """Code each contiguous run of documents into a file; returns ``(path, start, documents, tokens, bytes)``.

    A file's name is the place of its first document, so names ascend with doc_id and a repeated task writes the same.
    """
    spark = tokens.sparkSession
    shared = spark.sparkContext.broadcast((t.to_bytes(), offsets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, offset = shared.value
        own = Table.from_bytes(raw)

        def blocks() -> Iterator[Block]:
            ids, doc_ids, lengths, start, held, due = [], [], [], 0, 0, None
            for batch in batches:
                for doc_id, part, at, n, one in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    place = offset[part] + at
                    if ids and (due != place or held >= BLOCK_TOKENS):
                        yield Block(start, doc_ids, np.array(lengths), np.concatenate(ids))
                        ids, doc_ids, lengths, held = [], [], [], 0
                    if not ids:
                        start = place
                    ids.append(_id_array(one, n))
                    doc_ids.append(doc_id)
                    lengths.append(n)
                    held, due = held + n, place + n
            if ids:
                yield Block(start, doc_ids, np.array(lengths), np.concatenate(ids))

        def close(first: int, parts: list[bytes], index: list[tuple[int, int]], docs: int, n: int) -> tuple:
            path = f"{folder}/{first:016d}.qra"
            tail = b"".join(struct.pack("<QQ", *x) for x in index) + struct.pack("<I4s", len(index), b"QRAE")
            return path, first, docs, n, files.put(path, [struct.pack("<4sI", b"QRA1", own.crc), *parts, tail])

        rows: list[tuple] = []
        parts, index, size, first, docs, n, due = [], [], 8, 0, 0, 0, None
        for block in blocks():
            if parts and (due != block.start or size > 1 << 24):
                rows.append(close(first, parts, index, docs, n))
                parts, index, size, docs, n = [], [], 8, 0, 0
            if not parts:
                first = block.start
            index.append((size, block.start))
            parts.append(block_bytes(block, own))
            size += len(parts[-1])
            docs, n, due = docs + len(block.doc_ids), n + len(block.ids), block.start + len(block.ids)
        if parts:
            rows.append(close(first, parts, index, docs, n))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.string()] + [pa.int64()] * 4, strict=True)], ["path", "start", "documents", "tokens", "bytes"])

    return tokens.mapInArrow(run, "path string, start long, documents long, tokens long, bytes long")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write ``docs(doc_id, text, …)`` as coded files in ascending doc_id order; returns the manifest.

    Null and empty texts are one end id. Null ids come first; repeated ids keep their rows. An empty table writes the
    frequency table alone and returns an empty manifest. Other columns are ignored.
    """
    tokenizer = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    partitions = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tokens = written(tokenized(docs, tokenizer, end_id, partitions), "tokens")
    ranges = tokens.groupBy("part").agg(F.min("doc_id").alias("low"), F.sum("n").alias("n")).orderBy(F.asc_nulls_first("low"), "part").collect()
    offsets, at = {}, 0
    for r in ranges:
        offsets[r["part"]], at = at, at + r["n"]
    vocabulary = max(encoder(tokenizer).tokenizer.get_vocab_size(), end_id + 1)
    t = Table.of_counts(id_counts(tokens, vocabulary))
    files.put(f"{folder}/table.qrt", [t.to_bytes()])
    return written(write_files(tokens, folder, t, offsets), "token-files")


def read_tokens(spark: SparkSession, manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Decode the files -> ``(doc_id, start, n_tokens, ids_crc32)`` and, if asked for, the ids as an array.

    The files' indices are read first; blocks, not files, are then dealt to the tasks.
    """
    table_path = f"{folder}/table.qrt"

    def loaded() -> Table:
        with files.stream(table_path) as f:
            return Table.from_bytes(f.read())

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = loaded()
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with files.at(path) as f:
                    at = [position for position, _ in block_index(f, t)]
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(at)), pa.array(at, pa.int64())], ["path", "position"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = None
        for batch in batches:
            t = t or loaded()
            for path, position in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.at(path) as f:
                    f.seek(position)
                    b = read_block(f.read, t)
                ids, n = b.ids(t).astype("<u4", copy=False), b.lengths.astype(np.int64)
                after = np.cumsum(n)
                own = [ids[z - k : z] for z, k in zip(after.tolist(), n.tolist(), strict=True)]
                columns = [pa.array(b.doc_ids, pa.int64()), pa.array(b.start + after - n), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([x.tolist() for x in own], pa.list_(pa.int64()))] * with_ids, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    blocks = written(manifest.select("path").mapInArrow(index, "path string, position long"), "token-blocks")
    n = max(1, min(blocks.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return blocks.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def op9_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "rans")
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), folder), folder)
