"""Operator 3: SimHash near-duplicates, found with vantage-point trees.

Each text becomes a 64-bit fingerprint. Fingerprints at Hamming distance ``max_bits`` or less are linked exactly:

* The 64 bits are cut into ``bands``. Two fingerprints within ``max_bits`` are within ``max_bits // bands`` bits on
  one band at least, so each band gets a vantage-point tree over its own Hamming distance with that small radius.
  (A single tree over all 64 bits is also exact, but distances between unrelated fingerprints gather at 32 and a
  radius of 4 then keeps two thirds of the rows at every split; three bands of radius 1 keep a sixth.)
* The top of each tree is built on the driver from a bounded sample of fingerprints and sent to the tasks. A
  fingerprint goes to its home shard and, where the triangle bound allows a partner on the near side of a split, to
  that side as well. So every pair meets in a shard and no shard holds more than its share plus the overlap.
* Within a shard the same splits go on until the rest is small, and pairs are then compared exactly, in blocks. A shard
  returns one link per fingerprint to the smallest of its group there, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import table, written

_PART_BYTES = 1 << 22
#: Over so many tasks the fingerprints of one component are spread when they learn its smallest id.
SALTS = 16


_LANES = np.uint64(0x0101010101010101)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of each row's values (rows, n) have each bit. Eight byte-wide lanes add up 255 values at a time."""
    out = np.zeros((len(h), 8, 8), dtype=np.int64)
    starts = np.arange(0, h.shape[1], 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts, axis=1)
        out[:, :, k] = lanes.view(np.uint8).reshape(len(h), -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(len(h), 64)


def remixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes of the same shingles; seed 0 leaves them as they are."""
    if not seed:
        return h
    z = h + np.uint64(seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, repeats included, a few MB of text at a time. No word: nothing."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    digest = xxhash.xxh64_intdigest
    carry: list[bytes] = []
    count, at = 0, 0
    while at < len(raw) or at == 0:
        end = min(len(raw), at + _PART_BYTES)
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        words = carry + raw[at:end].split()
        last, at = end >= len(raw), max(end, 1)
        n = len(words)
        if n and (n >= shingle or (last and not count)):
            width = min(shingle, n)
            lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
            ends = np.cumsum(lengths + 1) - 1
            joined, starts = b" ".join(words), (ends - lengths)[: n - width + 1].tolist()
            yield np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)], dtype=np.uint64)
            count += n - width + 1
        carry = words[-(shingle - 1) :] if shingle > 1 else []
        if last:
            break


def fingerprint(text: str | None, shingle: int, seeds: int = 1) -> list[int]:
    """Majority of the bits of the shingles' hashes, for each of ``seeds`` mixes of them; signed 64 bits. No word: zeros."""
    count, ones = 0, np.zeros((seeds, 64), dtype=np.int64)
    for h in shingle_hashes(text, shingle):
        ones += bit_counts(np.stack([remixed(h, k) for k in range(seeds)]))
        count += len(h)
    return np.packbits(2 * ones > count, axis=1, bitorder="little").view("<i8")[:, 0].tolist() if count else [0] * seeds


def fingerprints(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """``(doc_id, fp)`` of every whole text; ``fp`` is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [fingerprint(x.as_py(), shingle)[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def band_masks(bands: int) -> list[int]:
    cuts = [64 * i // bands for i in range(bands + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]


def build_tree(sample: np.ndarray, mask: int, depth: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage fingerprints and median radii of a binary tree in heap order; radius -1 marks a leaf."""
    rng = np.random.default_rng(seed)
    size = (1 << (depth + 1)) - 1
    vantage, radius = np.zeros(size, dtype=np.uint64), np.full(size, -1, dtype=np.int16)
    todo = [(0, sample)]
    while todo:
        node, own = todo.pop()
        if 2 * node + 2 >= size or len(own) < 8:
            continue
        v = own[rng.integers(len(own))]
        d = np.bitwise_count((own ^ v) & np.uint64(mask))
        mid = int(np.median(d))
        if not (d > mid).any():
            mid -= 1
        if mid < 0 or not (d > mid).any():
            continue
        vantage[node], radius[node] = v, mid
        todo += [(2 * node + 1, own[d <= mid]), (2 * node + 2, own[d > mid])]
    return vantage, radius


def route(x: np.ndarray, vantage: np.ndarray, radius: np.ndarray, mask: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every fingerprint's home and of the near sides within ``reach`` of a split."""
    row, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    done_row, done_node = [], []
    while len(row):
        r = radius[node]
        leaf = r < 0
        done_row.append(row[leaf])
        done_node.append(node[leaf])
        row, node, r = row[~leaf], node[~leaf], r[~leaf]
        d = np.bitwise_count((x[row] ^ vantage[node]) & np.uint64(mask)).astype(np.int16)
        over = (d > r) & (d <= r + reach)
        row = np.concatenate([row, row[over]])
        node = np.concatenate([np.where(d <= r, 2 * node + 1, 2 * node + 2), 2 * node[over] + 1])
    return np.concatenate(done_row), np.concatenate(done_node)


def _groups(x: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, int]]:
    """Groups of linked fingerprints: each is compared only with those not yet reached."""
    rest = x
    while len(rest):
        found, todo = [rest[:1]], [rest[0]]
        rest = rest[1:]
        while todo and len(rest):
            hit = np.bitwise_count(rest ^ todo.pop()) <= max_bits
            if hit.any():
                found.append(rest[hit])
                todo.extend(rest[hit])
                rest = rest[~hit]
        if len(found) > 1:
            group = np.concatenate(found)
            yield group, group.view(np.int64).min()


def shard_links(x: np.ndarray, mask: int, reach: int, max_bits: int, block: int = 2048, depth: int = 24) -> list[np.ndarray]:
    """Links (n, 2) of signed fingerprints that keep every group of ``x`` together."""
    if len(x) > block and depth:
        d = np.bitwise_count((x ^ x[len(x) // 2]) & np.uint64(mask))
        mid = np.median(d)
        near, far = d <= mid + reach, d > mid
        if far.any() and near.sum() < 0.9 * len(x):
            return shard_links(x[near], mask, reach, max_bits, block, depth - 1) + shard_links(x[far], mask, reach, max_bits, block, depth - 1)
    if len(x) <= 4 * block:
        linked = np.zeros(len(x), dtype=bool)
        for i in range(0, len(x), 256):
            linked[i : i + 256] = (np.bitwise_count(x[i : i + 256, None] ^ x[None, :]) <= max_bits).sum(axis=1) > 1
        x = x[linked]
    out = []
    for group, least in _groups(x, max_bits):
        own = group.view(np.int64)
        own = own[own != least]
        out.append(np.stack([own, np.full(len(own), least)], axis=1))
    return out


def fingerprint_links(fps: DataFrame, max_bits: int = 4, bands: int = 3, shard_rows: int = 512, sample: int = 1 << 18) -> DataFrame:
    """Distinct fingerprints ``(fp)`` -> links ``(a, b)`` that connect every two within ``max_bits``.

    ``sample`` bounds the fingerprints from which the driver builds the trees; every fingerprint is routed and compared.
    """
    spark = fps.sparkSession
    n = fps.count()
    depth = int(np.ceil(np.log2(max(1, n / shard_rows))))
    depth = min(depth, int(np.log2(sample)) - 3)
    picked = fps.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(min(sample, 64 << depth)).toPandas()["fp"].to_numpy(dtype=np.int64)
    picked = picked.view(np.uint64)
    masks, reach = band_masks(bands), max_bits // bands
    trees = spark.sparkContext.broadcast([build_tree(picked, m, depth, seed) for seed, m in enumerate(masks)])

    def to_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["fp"].to_numpy(dtype=np.int64)
            for band, (vantage, radius) in enumerate(trees.value):
                row, node = route(own.view(np.uint64), vantage, radius, masks[band], reach)
                yield pd.DataFrame({"band": np.full(len(row), band, dtype=np.int32), "shard": node, "fp": own[row]})

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = shard_links(frame["fp"].to_numpy(dtype=np.int64).view(np.uint64), masks[key[0]], reach, max_bits)
        return pd.DataFrame(np.concatenate(found) if found else np.empty((0, 2), dtype=np.int64), columns=["a", "b"])

    shards = fps.select("fp").mapInPandas(to_shards, "band int, shard long, fp long")
    return shards.groupBy("band", "shard").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = 5, max_bits: int = 4, bands: int = 3) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(doc_id, fingerprint, component_id)``, one row per input row.

    Words are runs without ASCII white space, A-Z lower-cased; shingles keep repeats; a text of fewer words is one
    shingle. Null and empty texts have fingerprint zero and link like any other. Repeated ids keep their rows. A null
    id is fingerprinted too; its component is the smallest id that it reaches, null if it reaches none.
    An empty table gives no rows. Other columns are ignored.
    """
    own = written(fingerprints(docs, shingle), "fingerprints")
    fps = written(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    star = stars(fingerprint_links(fps, max_bits, bands))
    star = written(star.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(star.select("b", "b").distinct()), "members")
    # only linked fingerprints are joined by their root, in salts, since one root may have a third of them
    salt = F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt")
    member = star.join(fps.hint("merge"), "fp")
    least = member.groupBy("root", salt).agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = written(star.withColumn("salt", salt).join(least.hint("merge"), ["root", "salt"]).select("fp", "component_id"), "fingerprint-components")
    of = written(fps.join(of.hint("merge"), "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")), "components")
    return own.join(of.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4, bands=3)
