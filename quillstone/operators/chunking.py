"""Chunking (K1-K5): word windows in closed form, paragraphs packed in one pass over a text, Markdown by sections."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import content_hash, word_list

CHUNK = "struct<text:string,words:int>"
#: Texts whose chunks a worker holds at once, and characters of chunks in a batch that it hands back.
SLICE, BATCH_CHARS = 100, 1_000_000


def word_windows(words: Column, size: int, overlap: int) -> Column:
    """K2: windows of ``size`` words stepping ``size - overlap``; the last one reaches the end."""
    overlap = max(0, min(overlap, size - 1))
    if size <= 0:
        return F.array().cast("array<string>")
    step = size - overlap
    n = F.size(words)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    starts = F.sequence(F.lit(0), last)
    cut = F.transform(starts, lambda k: F.array_join(F.slice(words, k * step + 1, F.lit(size)), " "))
    return F.when(n > 0, cut).otherwise(F.array().cast("array<string>"))


def chunk_words(rows: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """K2 over a table: (key, index, chunk, words)."""
    own = rows.select(key, word_list(F.col(text)).alias("_w"))
    out = own.select(key, F.posexplode(word_windows(F.col("_w"), size, overlap)).alias("chunk_index", "chunk"))
    return out.withColumn("words", F.size(F.split("chunk", " ")))


#: Unicode white space, as Java's ``(?U)\\s`` has it.
_SPACE = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_SPACES = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WORDS, _ENDS, _BLANK = re.compile(_SPACE), re.compile(f"^{_SPACE}|{_SPACE}$"), re.compile(r"\n[ \t]*\n")


def _words(text: str) -> list[str]:
    return [w for w in _WORDS.split(text) if w]


def pack_paragraphs(text: str | None, size: int, overlap: int) -> list[tuple[str, int]]:
    """K3 for one text: (chunk, words). Every word is looked at a bounded number of times."""
    done: list[tuple[str, int]] = []
    parts: list[str] = []
    held = 0

    def tail(n: int) -> list[str]:
        own = _words(" ".join(parts)) if n > 0 else []  # parts have no more than ``size`` words
        return own[-n:] if n > 0 else []

    for paragraph in _BLANK.split(re.sub("\r\n?", "\n", text or "")):
        paragraph = _ENDS.sub("", paragraph)
        words = _words(paragraph)
        if not words:
            continue
        if len(words) <= size and held + len(words) <= size:
            parts.append(paragraph)
            held += len(words)
            continue
        carry = tail(overlap if len(words) > size else min(overlap, size - len(words)))
        if parts:
            done.append(("\n\n".join(parts), held))
        if len(words) > size:
            words = carry + words
            starts = range(0, max(1, len(words) - overlap), size - overlap)
            windows = [words[k : k + size] for k in starts]
            done += [(" ".join(w), len(w)) for w in windows[:-1]]
            parts, held = [" ".join(windows[-1])], len(windows[-1])
        else:
            parts, held = [x for x in (" ".join(carry), paragraph) if x], len(carry) + len(words)
    return done + [("\n\n".join(parts), held)] if parts else done


def pack_batches(batches: Iterator[pd.Series], size: int, overlap: int) -> Iterator[pd.Series]:
    """The chunks of batches of texts, ``SLICE`` texts at a time."""
    for texts in batches:
        for k in range(0, len(texts), SLICE):
            yield pd.Series([[{"text": t, "words": n} for t, n in pack_paragraphs(x, size, overlap)] for x in texts.iloc[k : k + SLICE]])


def paragraph_chunks(text: Column, size: int, overlap: int) -> Column:
    """K3: blank-line paragraphs packed up to ``size`` words as ``array<struct<text, words>>``.

    A full chunk hands its last ``min(overlap, size - next)`` words to the next one; they count there. A paragraph of more
    than ``size`` words is cut by K2 with the carried words in front. The fold depends on its own carry, so it runs as a pandas
    function, once over each text; the chunks of ``SLICE`` texts at a time are in a worker.
    """
    if size <= 0:
        return F.array().cast(f"array<{CHUNK}>")
    overlap = max(0, min(overlap, size - 1))

    @F.pandas_udf(f"array<{CHUNK}>")
    def pack(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return pack_batches(batches, size, overlap)

    return pack(text)


def split_sections(text: str | None) -> list[tuple[int, str, str]]:
    """(section, heading, body) of one Markdown text: lines starting with ``#`` and some text begin a section; empty bodies go."""
    if text is None:
        return []
    found: list[tuple[str, list[str]]] = [("", [])]
    for line in re.sub("\r\n?", "\n", text).split("\n"):
        own = line.strip(_SPACES)
        if own.startswith("#") and own.strip("#"):
            found.append((own.lstrip("#").strip(_SPACES), []))
        else:
            found[-1][1].append(line)
    out = ((k, heading, "\n".join(lines)) for k, (heading, lines) in enumerate(found))
    return [(k, heading, body) for k, heading, body in out if body.strip(_SPACES)]


def _per_text(rows: DataFrame, key: str, text: str, schema: str, of: Callable[[str | None], Iterable[tuple]]) -> DataFrame:
    """The rows of every text, without a shuffle, in batches of about ``BATCH_CHARS`` characters."""
    own = rows.select(key, text)
    names = [f.split()[0] for f in schema.split(", ")]
    types = [pa.int32() if f.endswith(" int") else pa.string() for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, at, out, held = batch.schema.field(0).type, [], [], 0

            def flush() -> pa.RecordBatch:
                columns = zip(*out, strict=True) if out else [[]] * len(names)
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], [key, *names])

            for i in range(batch.num_rows):
                for row in of(batch.column(1)[i].as_py()):
                    at.append(i)
                    out.append(row)
                    held += len(row[2])  # body or text
                    if held >= BATCH_CHARS:
                        yield flush()
                        at, out, held = [], [], 0
            if out:
                yield flush()

    return own.mapInArrow(run, StructType([own.schema[0], *StructType.fromDDL(schema).fields]))


def sections(markdown: DataFrame, key: str, text: str) -> DataFrame:
    """(key, section, heading, body): see ``split_sections``."""
    return _per_text(markdown, key, text, "section int, heading string, body string", split_sections)


def chunk_markdown(markdown: DataFrame, key: str, text: str, size: int, overlap: int) -> DataFrame:
    """K1: chunks of every section, numbered over the whole document. In one pass over a text: no section travels with the
    lines of the others, and nothing is grouped again."""
    overlap = max(0, min(overlap, size - 1))

    def chunks(x: str | None) -> Iterator[tuple]:
        every = ((h, t, n) for _, h, body in split_sections(x) for t, n in pack_paragraphs(body, size, overlap)) if size > 0 else ()
        return ((k, *c) for k, c in enumerate(every))

    return _per_text(markdown, key, text, "chunk_index int, heading string, text string, words int", chunks)


def plan_refresh(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K4: per chunk ``retained``, ``replaced``, ``removed`` or ``added``, and whether it must be embedded."""
    o = old.select(*key, "chunk_index", F.col("content_hash").alias("_o"), F.col("is_current").alias("_c"))
    n = new.select(*key, "chunk_index", F.col("content_hash").alias("_n"))
    j = o.join(n.hint("merge"), [*key, "chunk_index"], "full_outer")
    action = F.when(F.col("_n").isNull(), "removed").when(F.col("_o").isNull(), "added").when(F.col("_o") == F.col("_n"), "retained").otherwise("replaced")
    embed = (F.col("action") != "removed") & ~((F.col("action") == "retained") & F.coalesce("_c", F.lit(False)))
    return j.withColumn("action", action).select(*key, "chunk_index", "action", embed.alias("embed"))


def plan_pdf_index(papers: DataFrame, chunks: DataFrame, chunk_types: tuple[str, ...] | None = ("pdf",)) -> DataFrame:
    """K5: papers with a PDF that are not wholly indexed; ``None`` counts every type of chunk."""
    own = chunks if chunk_types is None else chunks.filter(F.col("chunk_type").isin(list(chunk_types)))
    state = own.groupBy("paper_id").agg(F.bool_and("is_current").alias("_done"))
    hit = papers.filter(F.coalesce("pdf_url", F.lit("")) != "").join(state.hint("merge"), "paper_id", "left")
    return hit.filter(~F.coalesce("_done", F.lit(False))).drop("_done")


def hashed(chunks: DataFrame, text: str = "chunk") -> DataFrame:
    return chunks.withColumn("content_hash", content_hash(F.col(text)))
