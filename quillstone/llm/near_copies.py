"""Near copies of whole texts: candidates by SimHash and vantage-point trees, verified by exact shingle overlap.

Two texts that share 0.8 of their five-word shingles differ in about ten of 64 fingerprint bits, too many for one exact
search with a small radius. So each text has ``SEEDS`` independent fingerprints, each searched within ``MAX_BITS`` by the
trees of ``simhash``; a pair is a candidate if one of them is that close. Every
candidate link is then checked by the Jaccard similarity of the two sets of shingles, and only true ones join texts.

No shard returns all pairs of a group. In a first round each shard returns links that span its groups; what is
verified is joined into components. Then the pairs of texts within reach that still lie in different components are
compared, every one of them, so no candidate pair is left out. Most of these are well below the similarity, so a shard first bounds them by
sketches: bit b of a text's sketch is the parity of its shingles that hash to b. Common shingles cancel, so two sketches
differ in no more bits than their texts have shingles of their own; a pair that differs in more than the similarity
allows is none, and only the others leave the shard. A sketch has a bit a shingle at least, so it tells long texts apart
as well as short ones; a wider one is folded in halves to be compared with a narrower one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import release_arrow, small_batches, written
from .simhash import band_masks, build_tree, fingerprint, route, shingle_hashes

SHINGLE, SIMILARITY = 5, 0.8
SEEDS, MAX_BITS, BANDS = 4, 8, 5
SKETCH_BITS = 1024  # of a text of that many shingles or fewer; doubled until it has a bit a shingle
#: Pairs of one text beyond this many are verified in several tasks, each with a copy of the text's shingles.
PAIRS_A_PART = 256
#: Up to this many text keys are sent to all tasks to filter documents; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
FPS = [f"f{k}" for k in range(SEEDS)]
SETS = "key long, shingles array<long>, sketch binary"


def text_key(text: Column) -> Column:
    """64 bits that stand for a whole text; null is the empty text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def texts_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, key, f0, f1, …)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([fingerprint(x.as_py(), SHINGLE, SEEDS) for x in batch.column(2)], dtype=np.int64).reshape(-1, SEEDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(rows[:, k]) for k in range(SEEDS))], ["doc_id", "key", *FPS])
        release_arrow()

    return docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("key"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, " + ", ".join(f"{x} long" for x in FPS))


def forest(texts: DataFrame, shard_rows: int = 512, sample: int = 1 << 18) -> Broadcast:
    """A tree per fingerprint and band, built by the driver from a bounded sample; every text is routed and compared."""
    n = texts.count()
    depth = min(int(np.ceil(np.log2(max(1, n / shard_rows)))), int(np.log2(sample)) - 3)
    picked = texts.select(*FPS).orderBy(F.xxhash64("key"), "key").limit(min(sample, 64 << depth)).toPandas().to_numpy(dtype=np.int64).reshape(-1, SEEDS).view(np.uint64)
    return texts.sparkSession.sparkContext.broadcast([(k, mask, *build_tree(picked[:, k], mask, depth, 31 * k + b)) for k in range(SEEDS) for b, mask in enumerate(band_masks(BANDS))])


def _bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _cells(x: np.ndarray, mask: int, reach: int, block: int) -> Iterator[np.ndarray]:
    """Row numbers of overlapping cells of a shard, split on as the trees do, until they are small or hang together."""
    todo = [(np.arange(len(x)), 24)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) > block and depth:
            d = np.bitwise_count((x[rows] ^ x[rows[len(rows) // 2]]) & np.uint64(mask))
            mid = np.median(d)
            near, far = rows[d <= mid + reach], rows[d > mid]
            if len(far) and len(near) < 0.9 * len(rows):
                todo += [(near, depth - 1), (far, depth - 1)]
                continue
        yield rows


def _linked(x: np.ndarray) -> np.ndarray:
    """Rows with another within ``MAX_BITS``."""
    found = np.zeros(len(x), dtype=bool)
    for i in range(0, len(x), 256):
        found[i : i + 256] = (_bits(x[i : i + 256, None], x[None, :]) <= MAX_BITS).sum(axis=1) > 1
    return np.flatnonzero(found)


def spanning(keys: np.ndarray, x: np.ndarray, component: np.ndarray) -> np.ndarray:
    """Pairs (n, 2) of keys that connect every group of candidates; each row is compared with those not yet reached."""
    order = np.argsort(keys, kind="stable")
    keys, x, component = keys[order], x[order], component[order]
    rest, out = np.arange(len(keys)), []
    while len(rest):
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            p = todo.pop()
            hit = _bits(x[rest], x[p]) <= MAX_BITS
            if hit.any():
                found = rest[hit]
                todo.extend(found)
                other = found[component[found] != component[p]]
                out.append(np.stack([np.full(len(other), keys[p]), keys[other]], axis=1))
                rest = rest[~hit]
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def sketch_of(shingles: np.ndarray) -> np.ndarray:
    """The parities of distinct shingle hashes by their low bits, as 64-bit words."""
    bits = max(SKETCH_BITS, 1 << (len(shingles) - 1).bit_length() if len(shingles) else 0)
    at = shingles & np.int64(bits - 1)
    return np.packbits(np.bincount(at, minlength=bits) & 1, bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """The sketch of the same shingles at a smaller width of 64-bit words."""
    while len(sketch) > words:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def may_be_similar(sketch: np.ndarray, n: np.ndarray, own_sketch: np.ndarray, own_n: int) -> np.ndarray:
    """False only where a text with that sketch and number of shingles is below ``SIMILARITY`` to the own one: sets of
    s shingles in sum are that similar if at most s * (1 - SIMILARITY) / (1 + SIMILARITY) are not shared."""
    differ = np.bitwise_count(sketch ^ own_sketch).sum(axis=-1, dtype=np.int64)
    return differ <= (n + own_n) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-6


def remaining(keys: np.ndarray, x: np.ndarray, component: np.ndarray, sketch: list[np.ndarray], n_shingles: np.ndarray) -> np.ndarray:
    """All candidate pairs of different components that may be similar. Rows of the largest component are not compared
    with each other, and neither are texts of which one has less than ``SIMILARITY`` of the other's shingles."""
    names, code, n = np.unique(component, return_inverse=True, return_counts=True)
    if len(names) < 2:
        return np.empty((0, 2), dtype=np.int64)
    width = np.array([len(s) for s in sketch])
    table = {}
    for w in np.unique(width).tolist():  # at each width the sketches of texts of that width and of the next
        rows = np.flatnonzero((width == w) | (width == 2 * w))
        at = np.zeros(len(x), dtype=np.int64)
        at[rows] = np.arange(len(rows))
        table[w] = at, np.stack([folded(sketch[i], w) for i in rows])
    out = []
    for i in np.flatnonzero(code != n.argmax()):
        hit = np.flatnonzero((_bits(x, x[i]) <= MAX_BITS) & (code != code[i]) & ((code == n.argmax()) | (keys > keys[i])))
        hit = hit[np.minimum(n_shingles[hit], n_shingles[i]) >= SIMILARITY * np.maximum(n_shingles[hit], n_shingles[i]) - 1e-6]
        both = np.minimum(width[hit], width[i])
        for w in np.unique(both).tolist():
            at, words = table[w]
            some = hit[both == w]
            some = some[may_be_similar(words[at[some]], n_shingles[some], words[at[i]], n_shingles[i])]
            out.append(np.stack([np.full(len(some), keys[i]), keys[some]], axis=1))
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


def forest_of(pairs: np.ndarray) -> np.ndarray:
    """Those of the pairs (n, 2) that connect what the ones before them do not."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for i, (a, b) in enumerate(pairs.tolist()):
        a, b = find(a), find(b)
        if a != b:
            root[a] = b
            kept.append(i)
    return pairs[kept]


def candidates(texts: DataFrame, trees: Broadcast, chosen: list[int], all_pairs: bool = False) -> DataFrame:
    """``texts(key, component, f0, …)`` -> distinct candidate pairs ``(a, b)``, a < b, of different components by these
    trees: such as span every group of a shard, or all that may be similar by ``sketch`` and ``n``, then columns of texts."""
    reach, names = MAX_BITS // BANDS, [FPS[k] for k in sorted({k // BANDS for k in chosen})]
    extra = ["sketch", "n"] if all_pairs else []

    def to_shards(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for t, (seed, mask, vantage, radius) in enumerate(trees.value):
                if t in chosen:
                    own = frame[FPS[seed]].to_numpy(dtype=np.int64)
                    row, node = route(own.view(np.uint64), vantage, radius, mask, reach)
                    moved = {c: frame[c].to_numpy()[row] for c in ["key", "component", *extra]}
                    yield pd.DataFrame({"tree": np.full(len(row), t, dtype=np.int32), "shard": node, **moved, "fp": own[row]})
        release_arrow()

    def link(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = frame["fp"].to_numpy(dtype=np.int64).view(np.uint64)
        own = [frame["key"].to_numpy(dtype=np.int64), x, frame["component"].to_numpy(dtype=np.int64)]
        if all_pairs:
            sketch, n = [np.frombuffer(s, dtype=np.uint64) for s in frame["sketch"]], frame["n"].to_numpy(dtype=np.int64)
        out = [np.empty((0, 2), dtype=np.int64)]
        for rows in _cells(x, trees.value[key[0]][1], reach, 2048):
            if len(rows) <= 8192:
                rows = rows[_linked(x[rows])]
            if len(rows) > 1:
                part = [column[rows] for column in own]
                out.append(remaining(*part, [sketch[i] for i in rows], n[rows]) if all_pairs else spanning(*part))
        pairs = np.concatenate(out)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0) if all_pairs else forest_of(pairs)
        return pd.DataFrame({"a": pairs.min(axis=1), "b": pairs.max(axis=1)})

    shards = texts.select("key", "component", *names, *extra).mapInPandas(to_shards, "tree int, shard long, key long, component long, " + "sketch binary, n int, " * all_pairs + "fp long")
    return shards.groupBy("tree", "shard").applyInPandas(link, "a long, b long").distinct()


def shingle_sets(docs: DataFrame, texts: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, shingles array<long>, sketch)``: the distinct shingle hashes of these texts, each read from one of its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *shingle_hashes(x.as_py(), SHINGLE)])).view(np.int64) for x in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
            flat = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([batch.column(0), flat, pa.array([sketch_of(x).tobytes() for x in sets], pa.binary())], ["key", "shingles", "sketch"])
        release_arrow()

    wanted = written(texts.join(keys.hint("merge"), "key").select("key", "least"), "texts-to-compare")
    hint = "broadcast" if wanted.count() <= BROADCAST_KEYS else "merge"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("own"), F.col("text").cast("string").alias("text"))
    rows = rows.join(wanted.hint(hint), (F.col("own") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("least")), "inner")
    return rows.select("key", "text").mapInArrow(run, SETS).dropDuplicates(["key"])


def _with_shingles(rows: DataFrame, pairs: DataFrame, sets: DataFrame, side: str, name: str) -> DataFrame:
    """``rows``, one for each of the pairs, with the shingles of their texts ``side``. A text with many pairs has its shingles
    copied once for every ``PAIRS_A_PART`` of them, so that no task gets all pairs of a hot text."""
    parts = pairs.groupBy(side).agg(F.ceil(F.count("*") / PAIRS_A_PART).cast("int").alias("parts")).filter("parts > 1")
    dealt = rows.join(parts.hint("merge"), side, "left").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    own = sets.select(F.col("key").alias(side), F.col("shingles").alias(name)).join(parts.hint("merge"), side, "left")
    own = own.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return dealt.join(own.hint("merge"), [side, "part"]).drop("part")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose texts share ``SIMILARITY`` of their shingles. Two texts without any word are alike."""
    both = _with_shingles(_with_shingles(pairs, pairs, sets, "a", "x"), pairs, sets, "b", "y")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(shared >= F.lit(SIMILARITY) * (F.size("x") + F.size("y") - shared) - 1e-9).select("a", "b")


def text_groups(docs: DataFrame, own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``own`` of texts_of(docs) -> (``(key, least, n)`` of every distinct text, ``(a, b)``: text a belongs to b's group, its
    smallest key; texts alone in their group are left out)."""
    spark = docs.sparkSession
    texts = written(own.groupBy("key").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), *[F.first(x).alias(x) for x in FPS]), "texts")
    trees = forest(texts)
    sets = spark.createDataFrame([], SETS)
    star = spark.createDataFrame([], "a long, b long")
    every = list(range(SEEDS * BANDS))
    for last in (False, True):
        own_texts = texts.drop("n").join(sets.select("key", "sketch", F.size("shingles").alias("n")).hint("merge"), "key") if last else texts
        named = own_texts.join(star.select(F.col("a").alias("key"), F.col("b").alias("component")).hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key"))
        pairs = written(candidates(named, trees, every, last), "candidates")
        new = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct().join(sets.select("key").hint("merge"), "key", "left_anti")
        with small_batches(spark):
            sets = sets.unionByName(written(shingle_sets(docs, texts, new), "shingle-sets"))
        links = written(verified(pairs, sets), "links")
        if links.limit(1).count():
            star = stars(star.unionByName(links))
    return texts.select("key", "least", "n"), star


def keep_one(docs: DataFrame) -> DataFrame:
    """Documents without near copies: of each group of linked texts one row stays, that with the smallest id.

    Texts are linked at a Jaccard similarity of 0.8 of their sets of five-word shingles (A-Z lower-cased; a text of
    fewer words is one shingle; null, empty and blank texts are alike) and groups are what links connect. Candidates are
    exact within the radius of ``MAX_BITS`` of a fingerprint; see the README for the share of pairs at 0.8 beyond it. A null
    id counts as the largest. Of rows with the smallest id and different texts of a group, the one with the smallest text
    key stays; of rows equal in id and text, the one with the smallest hash of its other columns. Rows
    of one id whose texts lie in different groups stay all. An empty table gives no rows; other columns pass through.
    """
    with small_batches(docs.sparkSession):
        own = written(texts_of(docs), "text-fingerprints")
    texts, star = text_groups(docs, own)
    member = star.select(F.col("a").alias("key"), F.col("b").alias("group")).union(star.select("b", "b").distinct())
    member = written(member.join(texts.hint("merge"), "key"), "group-texts")
    rank = F.struct(F.col("least").isNull().alias("no_id"), F.col("least"), F.col("key"))
    best = member.groupBy("group").agg(F.min(rank).alias("best")).select(F.col("best.key").alias("key"))
    gone = member.join(best.hint("merge"), "key", "left_anti").select("key")
    gone = gone.withColumn("least", F.lit(None).cast("long")).withColumn("whole", F.lit(True))
    copied = texts.filter("n > 1").join(gone.select("key").hint("merge"), "key", "left_anti").select("key", "least", F.lit(False).alias("whole"))
    drop = written(gone.unionByName(copied), "copies")
    hint = "broadcast" if drop.count() <= BROADCAST_KEYS else "merge"
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(whole.alias("row"), text_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("hash"))
    rows = rows.join(drop.hint(hint), "key", "left").filter(F.col("whole").isNull() | (~F.col("whole") & F.col("id").eqNullSafe(F.col("least"))))
    if own.groupBy("key", "doc_id").count().filter("count > 1").limit(1).count():  # rows equal in id and text
        one = rows.filter(F.col("whole").isNotNull()).groupBy("key", "id").agg(F.min_by("row", "hash").alias("row"))
        rows = rows.filter(F.col("whole").isNull()).select("row").unionByName(one.select("row"))
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
