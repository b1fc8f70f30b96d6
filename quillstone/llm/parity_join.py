"""Operator 12: exact Jaccard join of texts on word shingles, by parity sketches.

Every shingle of a text flips one bit of the text's sketch, so shingles that two texts share cancel out and two sketches
differ in no more bits than the texts have shingles of their own. At a similarity of ``percent`` those are few, and
how many follows from the sizes alone, so texts are dealt into bands of sizes in which a text can only link to its own band
and the next. In a band where linked texts differ in D shingles at most, sketches are cut into more than D words (a
word is kept as the XOR of 64-bit codes of its odd bits, so it can be wide): by the pigeonhole principle linked
texts have a word in common, and texts are joined on (band, place, word).

* A word with hardly any odd bit would be common by chance. There are some words more than D + 1, so a text may leave such
  words out while a fuller one must agree as well; a text with too many of them also gives them, each with the words
  of a second sketch.
* Equal sets of shingles are one row from the start; a text gives its words once per task.
* No group of texts with a common word returns all its pairs. First every text is linked to the smallest of the group; what
  is verified is joined into components. Then pairs of a group that lie in different components are compared: in small
  groups by Spark's join, in large ones by dense sketches, block by block in as many tasks as there are pairs of blocks. A first
  round returns the ``CLOSEST`` texts of other components for each text and names the groups where there were more within
  the bound of the sketches; a second one returns all that are left there. Pairs are verified by the exact overlap of
  their shingles.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.graph import stars
from .common import table, written

SHINGLE, PERCENT = 4, 85
#: Words of a sketch with at most so many shingles are left out where others must agree.
LIGHT = 1
#: So many words of 100 more than needed there are. With fewer, many texts have too many light words to leave them all out.
SPARE = 20
#: Groups of texts with a common word are compared by Spark's join up to this size, and beyond it in blocks of ``BLOCK``.
SMALL, BLOCK = 16, 2048
#: So many texts of other components each text of a large group is compared with exactly before all are.
CLOSEST = 3
#: Up to this many rows are sent to all tasks to filter documents; more are joined by a shuffle.
BROADCAST_KEYS = 500_000
#: Over so many tasks the texts of one component are spread when they learn its smallest id.
SALTS = 16
_LOW = np.uint64(0xFFFFFFFF)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Other 64 bits for every unsigned 64-bit value."""
    z = x + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def shingle_set(text: bytes | None, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; a text of fewer words is one shingle, one without words none."""
    words = (text or b"").lower().split()
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(width, len(words))
    out = np.full(max(0, len(h) - width + 1) if width else 0, width, dtype=np.uint64)
    for k in range(width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += h[k : k + len(out)]
    return distinct(mixed(out))


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit value that stands for a whole set."""
    return int((np.bitwise_xor.reduce(own) ^ np.uint64(len(own))).view(np.int64)) if len(own) else 0


def most_different(total: int, percent: int = PERCENT) -> int:
    """How many shingles at most two linked sets of ``total`` in sum do not share."""
    return total * (100 - percent) // (100 + percent)


@cache
def _starts(percent: int, bands: int) -> list[int]:
    starts = [1]
    while len(starts) < bands:
        starts.append(starts[-1] * 100 // percent + 1)
    return starts


def band_of(n: int, percent: int = PERCENT) -> tuple[int, int]:
    """(band of sets of n shingles, largest size in it): its smallest set links to none beyond it, the largest to the next."""
    bands = 64
    while _starts(percent, bands)[-1] <= n:
        bands *= 2
    starts = _starts(percent, bands)
    band = bisect_right(starts, n) - 1
    return band, starts[band] * 100 // percent


def _words(own: np.ndarray, part: np.ndarray, m: int) -> np.ndarray:
    words = np.zeros(m, dtype=np.uint64)
    np.bitwise_xor.at(words, part, own)
    return words


def join_keys(own: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """64-bit keys of (band, place, word): two sets at ``percent`` or more that are not equal have one in common."""
    out = [np.empty(0, dtype=np.uint64)]
    band, _ = band_of(max(1, len(own)), percent)
    for b in range(max(0, band - 1), band + 1) if len(own) else ():
        top = _starts(percent, band + 2)[b] * 100 // percent
        differ = most_different(top + top * 100 // percent, percent)
        if not differ:  # such sets can only be equal
            continue
        m = differ + 1 + (differ + 1) * SPARE // 100 + (differ >= 8)
        part = ((own >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        light = np.bincount(part, minlength=m) <= LIGHT
        words = _words(own, part, m)
        at = np.uint64(b << 32) + np.arange(m, dtype=np.uint64)
        out.append(mixed(words ^ mixed(at, 3), 4)[~light])
        if light.sum() >= m - differ:
            second = _words(own, ((own & _LOW) * np.uint64(m) >> np.uint64(32)).astype(np.int64), m)
            first = mixed(words ^ mixed(at, 6), 7)[light]
            out.append(mixed(second[None, :] ^ mixed(at, 8)[None, :] ^ first[:, None], 9).ravel())
    return np.concatenate(out)


def sketch(own: np.ndarray) -> np.ndarray:
    """A dense parity sketch of sixteen bits or more a shingle, as 64-bit words. Halves can be folded by XOR."""
    bits = 1 << max(10, int(16 * len(own) - 1).bit_length())
    at = (own & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(np.uint64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """The sketch at ``size`` words, a power of two."""
    return np.bitwise_xor.reduce(words.reshape(-1, size), axis=0)


def pairs_of_blocks(rows: pa.Table, percent: int = PERCENT, closest: int | None = None) -> tuple[np.ndarray, bool]:
    """Pairs (n, 2) of keys of different components whose sketches allow ``percent``: of one block, or of two blocks each
    with the other. With ``closest``, a text of the first block has only so many, those that differ least; then also
    whether any had more."""
    words = [np.frombuffer(x, dtype=np.uint64) for x in rows["sketch"].to_pylist()]
    least = min(map(len, words))
    x = np.stack([folded(w, least) for w in words])
    keys, group, n, block = (rows[c].to_numpy().astype(np.int64) for c in ("key", "component", "n", "block"))
    one = block == block.min()
    two = np.flatnonzero(~one) if not one.all() else np.arange(len(keys))
    out, more = [np.empty((0, 2), dtype=np.int64)], False
    for i in np.flatnonzero(one):
        other = two[group[two] != group[i]]
        if one.all() and closest is None:
            other = other[keys[other] > keys[i]]
        differ = np.bitwise_count(x[other] ^ x[i]).sum(axis=1, dtype=np.int64)
        near = differ <= (n[other] + n[i]) * (100 - percent) // (100 + percent)
        other, differ = other[near], differ[near]
        if closest is not None and len(other) > closest:
            other, more = other[np.argpartition(differ, closest)[:closest]], True
        out.append(np.stack([np.full(len(other), keys[i]), keys[other]], axis=1))
    return np.concatenate(out), more


def texts_of(docs: DataFrame, width: int) -> DataFrame:
    """``(doc_id, key, n)`` of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), width) for x in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "key", "n"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, key long, n long")


def keyed_words(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``(word, key)``: the join keys of every set, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            words, keys = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
            for x in batch.column(0).cast(pa.binary()):
                own = shingle_set(x.as_py(), width)
                key = set_key(own)
                if key not in seen:
                    seen.add(key)
                    words.append(join_keys(own, percent))
                    keys.append(np.full(len(words[-1]), key))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(words).view(np.int64)), pa.array(np.concatenate(keys))], ["word", "key"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "word long, key long")


def shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``(key, shingles array<long>, sketch)`` of ``wanted(key, least)``, each read from its row with the id ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(x.as_py(), width) for x in batch.column(0).cast(pa.binary())]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            flat = pa.array(np.concatenate([np.empty(0, dtype=np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.int64()), pa.ListArray.from_arrays(offsets, flat), pa.array([sketch(s).tobytes() for s in sets], pa.binary())], ["key", "shingles", "sketch"])

    ids = wanted.select("least").distinct()
    hint = "broadcast" if ids.count() <= BROADCAST_KEYS else "merge"
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(ids.hint(hint), F.col("_id").eqNullSafe(F.col("least")))
    made = rows.select("text").mapInArrow(run, "key long, shingles array<long>, sketch binary")
    return made.join(wanted.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    one = pairs.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")).hint("merge"), "a")
    both = one.join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")).hint("merge"), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")


def mixed_groups(members: DataFrame, star: DataFrame) -> DataFrame:
    """``(word, key, component, size)`` of the groups with a common word that lie in several components."""
    component = star.select(F.col("a").alias("key"), F.col("b").alias("component"))
    named = members.select("word", "key").join(component.hint("merge"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    group = Window.partitionBy("word")
    sized = named.withColumns({"lo": F.min("component").over(group), "hi": F.max("component").over(group), "size": F.count("*").over(group)})
    return sized.filter("lo < hi").select("word", "key", "component", "size")


def small_pairs(rows: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of different components in groups of few texts."""
    other = rows.select("word", F.col("key").alias("key2"), F.col("component").alias("component2"))
    return rows.join(other.hint("merge"), "word").filter("key < key2 AND component != component2").select(F.col("key").alias("a"), F.col("key2").alias("b"))


def large_pairs(rows: DataFrame, sets: DataFrame, percent: int, closest: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs ``(a, b)`` of different components in groups of any size, but for such as the sketches rule out; with
    ``closest``, a row ``more`` (the word) for a group where a text had more than so many."""
    many = rows.withColumn("blocks", F.ceil(F.col("size") / block).cast("int")).withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cells = many.select("word", "key", "component", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    cells = cells.select("word", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "key", "component", "block")
    cells = cells.join(sets.select("key", F.size("shingles").alias("n"), "sketch").hint("merge"), "key")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        found, more = pairs_of_blocks(table, percent, closest)
        none = [None] if more else []
        pairs = pa.table({"a": found.min(axis=1), "b": found.max(axis=1), "more": pa.nulls(len(found), pa.int64())})
        return pa.concat_tables([pairs, pa.table({"a": pa.array(none, pa.int64()), "b": pa.array(none, pa.int64()), "more": pa.array([key[0].as_py()][: len(none)], pa.int64())})])

    return cells.groupBy("word", "i", "j").applyInArrow(compare, "a long, b long, more long")


def jaccard_components(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(doc_id, n_shingles, component_id)``, one row per input row.

    A text's set has its distinct shingles of ``width`` words (A-Z lower-cased, parted by ASCII white space); fewer words
    are one shingle. Sets link when they share ``percent`` of 100 of their union; ``component_id`` is the smallest
    id reachable by links. Null, empty and blank texts have no shingle and link with nothing: their component is their own
    id. Repeated ids keep their rows, which link by their texts. A null id has the smallest id that it reaches, null if it
    reaches none. An empty table gives no rows; other columns are ignored. Shingles and sets stand as 64-bit hashes.
    """
    own = written(texts_of(docs, width), "shingle-counts")
    texts = own.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    group = Window.partitionBy("word")
    words = keyed_words(docs, width, percent).withColumns({"lo": F.min("key").over(group), "hi": F.max("key").over(group)})
    members = written(words.filter("lo < hi").select("word", "key", "lo").distinct(), "common-words")
    wanted = written(members.select("key").distinct().join(texts.hint("merge"), "key"), "texts-to-compare")
    sets = written(shingle_sets(docs, wanted, width), "shingle-sets")

    def joined(star: DataFrame, pairs: DataFrame) -> DataFrame:
        links = written(verified(pairs, sets, percent), "links")
        return stars(star.unionByName(links), stored=True) if links.limit(1).count() else star

    first = written(members.filter("lo < key").select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct(), "candidates")
    star = joined(docs.sparkSession.createDataFrame([], "a long, b long"), first)
    rows = written(mixed_groups(members, star), "mixed-groups")
    near = written(large_pairs(rows.filter(F.col("size") > SMALL), sets, percent, CLOSEST), "closest-texts")
    pairs = near.filter("more IS NULL").select("a", "b").unionByName(small_pairs(rows.filter(F.col("size") <= SMALL)))
    star = joined(star, written(pairs.distinct(), "pairs"))
    again = members.join(near.filter("more IS NOT NULL").select(F.col("more").alias("word")).distinct().hint("merge"), "word", "left_semi")
    rest = large_pairs(mixed_groups(again, star), sets, percent).select("a", "b")
    star = joined(star, written(rest.distinct(), "remaining-pairs"))
    member = written(star.select(F.col("a").alias("key"), F.col("b").alias("root")).union(star.select("b", "b").distinct()), "members")
    # one component may have a third of the texts: they learn its smallest id in salts
    salt = F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")
    least = member.join(texts.hint("merge"), "key").groupBy("root", salt.alias("salt")).agg(F.min("least").alias("least")).groupBy("root").agg(F.min("least").alias("component_id"))
    least = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = member.withColumn("salt", salt).join(least.hint("merge"), ["root", "salt"]).select("key", "component_id")
    of = written(texts.join(of.hint("merge"), "key", "left").select("key", F.coalesce("component_id", "least").alias("component_id")), "components")
    return own.join(of.hint("merge"), "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op12_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < {SHINGLE} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END) AS s FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
k AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y USING (s) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM k JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {PERCENT} * (x.n + y.n - k)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
