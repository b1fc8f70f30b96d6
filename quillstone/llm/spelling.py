"""Operator 13: groups of spelling variants, by neighbourhoods over a reduced alphabet.

Words that differ by one inserted, deleted or replaced letter still differ by one edit at most when every letter is
replaced by one of a few symbols. So the distinct reduced words are few, a reduced word has only some dozens of
neighbours within one edit, and all of them can be generated and joined with the reduced vocabulary; pairs of
original words are then verified. A frequent word's variants hang on it, and chains of forms are followed to their end.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

LEAST_LENGTH, LEAST_COUNT, RATIO, SYMBOLS = 5, 3, 2, 6
_RUN = re.compile("[a-zÀ-ÿ]+")
#: A task hands its counts on when it has this many words.
_FLUSH = 500_000

#: What a run of letters of a document counts as: (bytes of the id, the run) -> word.
Reading = Callable[[bytes, str], str]


def as_written(doc_id: bytes, run: str) -> str:
    return run


def slipped(doc_id: bytes, run: str) -> str:
    """The query's reading: where 97 divides the crc32 of ``<doc_id>:<run>``, one letter of the run is missing."""
    h = zlib.crc32(run.encode(), zlib.crc32(doc_id + b":"))
    if h % 97:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, reading: Reading = as_written, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """``(word, n)``: the words of all texts with their counts; words are added up in the tasks before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                own = b"" if doc_id is None else b"%d" % doc_id
                for word, n in Counter(_RUN.findall((text or b"").lower().decode())).items():
                    if len(word) >= least_length and len(word := reading(own, word)) >= least_length:
                        total[word] += n
            if len(total) > _FLUSH:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                total.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    counts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def reduced(word: str, symbols: int = SYMBOLS) -> bytes:
    """One of a few symbols for every letter."""
    return bytes(ord(c) * 2654435761 % 4294967291 % symbols for c in word)


def neighbourhood(word: bytes, symbols: int = SYMBOLS) -> set[bytes]:
    """The reduced word and every one within one edit of it."""
    every = [bytes([s]) for s in range(symbols)]
    out = {word}
    for i in range(len(word) + 1):
        before, after = word[:i], word[i:]
        out.update(before + s + after for s in every)
        if after:
            out.add(before + after[1:])
            out.update(before + s + after[1:] for s in every)
    return out


def _code(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``words(word, n)`` -> ``(word, near, near_n)`` for every two words that differ by exactly one edit, in both orders."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [reduced(w, symbols) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low, pa.binary()), pa.array([_code(x) for x in low], pa.int64())], ["word", "n", "reduced", "code"])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                codes = [np.array([_code(x) for x in neighbourhood(w, symbols)], dtype=np.int64) for w in part.column(0).to_pylist()]
                own = np.repeat(part.column(1).to_numpy(), [len(c) for c in codes])
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.concatenate(codes))], ["code", "other"])

    coded = written(words.select("word", "n").mapInArrow(reduce, "word string, n long, reduced binary, code long"), "reduced-words")
    forms = coded.select("reduced", "code").distinct()
    reach = forms.mapInArrow(expand, "code long, other long").filter("code <= other")
    met = written(reach.join(forms.select(F.col("code").alias("other")).hint("merge"), "other", "left_semi"), "reduced-pairs")
    one = met.join(coded.select("code", "word", "n").hint("merge"), "code")
    two = coded.select(F.col("code").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    close = (F.abs(F.length("word") - F.length("near")) <= 1) & (F.col("word") != F.col("near")) & ((F.col("code") < F.col("other")) | (F.col("word") < F.col("near")))
    pairs = one.join(two.hint("merge"), "other").filter(close).filter(F.levenshtein("word", "near", 1) == 1)
    pairs = written(pairs.select("word", "n", "near", "near_n"), "near-words")
    return pairs.select("word", "near", "near_n").union(pairs.select("near", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """``(word, form)`` without cycles -> ``(word, root)``: the end of each chain, whose length is doubled in every round."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        stepped = written(ends.join(further.hint("merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ends = stepped.select("word", "root")
        if not stepped.filter("moved").limit(1).count():
            return ends


def variants(docs: DataFrame, reading: Reading = as_written, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, symbols: int = SYMBOLS) -> DataFrame:
    """``docs(doc_id, text, …)`` -> ``(word, n, n_near, form, form_n, root)``, one row per word.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, of ``least_length`` code points or more
    and ``least_count`` occurrences in all. A word's form is its most frequent near word (ties: the smallest in code-point
    order) if that is ``ratio`` times as frequent, else null; ``root`` is the end of its chain of forms, the word itself
    without one. Null and empty texts have no words; repeated rows count again; a null id is an empty text to
    ``reading``. An empty table gives no rows; other columns are ignored.
    """
    words = written(vocabulary(docs, reading, least_length, least_count), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near")))
    near = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    joined = words.join(near.hint("merge"), "word", "left")
    has = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    rows = joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.near")).alias("form"), F.when(has, -F.col("best.n")).alias("form_n"))
    rows = written(rows, "forms")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = variants(table(spark, sf_dir, "documents"), slipped)
    return found.select("word", "form", "root", "n", "n_near", "form_n")
