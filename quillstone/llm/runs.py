"""Operator 11: periodic runs of words, by a suffix automaton whose link tree is walked with link-cut access.

A run is a stretch of words with smallest period q, at least two periods long, that cannot be extended. Words are
appended one by one. The link path of the prefix's state holds all its suffixes, and each node of the path remembers where
its words ended last. Nodes next to each other on the path with the same memory are one segment (a preferred path of the
link-cut tree), so an access visits few segments: each says "the last ``size`` words also ended at ``before``". If the
distance between both ends is within ``size``, the words around it are a square of that period, and ``size`` is how far
it reaches to the left; it is then followed to the right to give the run. A square of a period that is a multiple of a
smaller one never shows up, since the smaller distance has already recoloured its nodes.

Texts hold few repeats, so the automaton is built only over stretches where it can find something: a run of ``least``
words or more has ``least / 2`` words in a row that come again, hence lies within a stretch covered by such repeated grams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LEAST = 12
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def automaton(words: list[bytes]) -> tuple[list[int], list[int], list[int]]:
    """Links and longest lengths of the states of the suffix automaton (0 is its root), and the state of every prefix."""
    to: list[dict[bytes, int]] = [{}]
    link, size, prefix, last = [-1], [0], [], 0
    for i, w in enumerate(words):
        new, p = len(size), last
        to.append({})
        size.append(i + 1)
        link.append(0)
        while p >= 0 and w not in to[p]:
            to[p][w] = new
            p = link[p]
        if p >= 0:
            q = to[p][w]
            if size[q] != size[p] + 1:
                copy = len(size)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = copy
                while p >= 0 and to[p].get(w) == q:
                    to[p][w] = copy
                    p = link[p]
                q = copy
            link[new] = q
        last = new
        prefix.append(new)
    return link, size, prefix


def accessor(link: list[int], size: list[int]) -> Callable[[int, int], list[tuple[int, int]]]:
    """``access(state, now)`` of a link-cut tree over the links: the segments of the path from the state to the root as
    (where it ended last, longest length), all of which then have ended at ``now``.

    Preferred paths are splay trees by depth; the root of each keeps the path's last end. Node 0, the empty word, is
    left out and stands for "none".
    """
    up = [max(x, 0) for x in link]
    left, right, seen = [0] * len(link), [0] * len(link), [-1] * len(link)

    def rotate(x: int) -> None:
        y = up[x]
        z = up[y]
        if left[z] == y and z:
            left[z] = x
        elif right[z] == y and z:
            right[z] = x
        else:
            seen[x] = seen[y]
        if left[y] == x:
            b = left[y] = right[x]
            right[x] = y
        else:
            b = right[y] = left[x]
            left[x] = y
        if b:
            up[b] = y
        up[y] = x
        up[x] = z

    def splay(x: int) -> None:
        while (y := up[x]) and (left[y] == x or right[y] == x):
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                rotate(y if (left[y] == x) == (left[z] == y) else x)
            rotate(x)

    def access(state: int, now: int) -> list[tuple[int, int]]:
        segments, below, x = [], 0, state
        while x:
            splay(x)
            if seen[x] >= 0:
                segments.append((seen[x], size[x]))
            if right[x]:
                seen[right[x]] = seen[x]
            right[x] = below
            below, x = x, up[x]
        seen[below] = now
        return segments

    return access


def runs_of(words: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run of at least ``least`` words and two periods."""
    link, size, prefix = automaton(words)
    access = accessor(link, size)
    found, reached = [], {}
    for i, state in enumerate(prefix):
        for before, longest in access(state, i):
            period = i - before
            if period <= longest and reached.get(period, -1) < i:
                end = i + 1
                while end < len(words) and words[end] == words[end - period]:
                    end += 1
                reached[period] = end - 1
                start = before - longest + 1
                if end - start >= least:
                    found.append((start, end - start, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _again(grams: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.argsort(grams)
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    out = np.zeros(len(grams), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def stretches(hashes: np.ndarray, least: int = LEAST) -> list[tuple[int, int]]:
    """(start, end) of the stretches outside of which no run of ``least`` words lies."""
    width = (least + 1) // 2
    n = len(hashes) - width + 1
    if n < 2:
        return []
    grams = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        grams = grams * _FACTOR + hashes[k : k + n]
    place = np.zeros(n, dtype=np.uint64)
    kept = n + 1
    where = np.arange(n)
    while True:  # a gram counts only if it comes again in its own stretch
        where = where[_again(grams[where] ^ (place[where] * _FACTOR))]
        if not len(where):
            return []
        first = np.flatnonzero(np.diff(where, prepend=-least) > width)
        starts, ends = where[first], where[np.append(first[1:] - 1, len(where) - 1)] + width
        place[where] = np.repeat(starts, np.diff(np.append(first, len(where)))).astype(np.uint64)
        long = (ends - starts >= least)[np.searchsorted(starts, where, "right") - 1]
        if len(where) == kept:
            return [(int(a), int(b)) for a, b in zip(starts, ends, strict=True) if b - a >= least]
        where = where[long]
        kept = len(where)


def text_runs(text: bytes | None, least: int = LEAST) -> tuple[int, list[tuple[int, int, int]], bytes]:
    """(number of words, runs, the words without repeats of a run's first period, joined by spaces)."""
    words = (text or b"").split()
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    runs = [(a + s, n, q) for a, b in stretches(hashes, least) for s, n, q in runs_of(words[a:b], least)]
    if not runs:
        return len(words), [], b" ".join(words)
    step = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    return len(words), runs, b" ".join(compress(words, np.cumsum(step)[:-1] == 0))


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(doc_id, n_words, runs, collapsed)``, one row per input row.

    ``runs`` has every maximal run of at least ``least`` words and two periods as (start, length, period), by start, then
    period, words counted from 0 and parted by ASCII white space. ``collapsed`` is the text without the words that a run
    repeats after its first period. Null, empty and blank texts have no word, no run and an empty collapsed text. Repeated
    and null ids keep their rows; an empty table gives no rows; other columns are ignored. A task holds the words of one text
    at a time; very long texts are not cut.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [text_runs(x.as_py(), least) for x in batch.column(1).cast(pa.binary())]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int32))
            flat = np.array([x for r in rows for x in r[1]], dtype=np.int64).reshape(-1, 3)
            runs = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows], pa.int64()), runs, pa.array([r[2] for r in rows], pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """The texts of the query: of every tenth document by crc32 of its id, the words from a place on repeat with a period
    that leaves three to eleven copies."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    own = own.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    own = own.withColumn("p", (F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8))).cast("int"))
    repeated = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), 11)), F.lit(1), F.col("n") - F.col("a"))
    return own.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), repeated), " ")).otherwise(F.col("text")).alias("text"))


def _line(r: Column) -> Column:
    return F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(planted(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    rows = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(F.lit(1000) * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", _line), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
