"""Operator 6: quality rules with a divergence test against language references. Built-in functions only.

The references come from the corpus itself, one for each value of ``lang``: the histogram of character classes, and the
common words, which are those that make up at least ``common_share`` of all words of the language. A document is compared
with the reference of its own language by Jensen-Shannon distance, for words twice: the common words among themselves,
and with one bin more for all other words, which tells texts with hardly any common word. Documents
without a language, or of a language with few documents, have no reference and are not tested; nor are short
documents, whose histograms say little.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_GAP, table, written

CLASSES = ("c_lower", "c_upper", "c_caseless", "c_digit", "c_space", "c_punct", "c_other")
_SPACE = " \t\n\x0b\x0c\r"
#: Up to this many languages and distinct common words are sent to all tasks; more are joined by a shuffle.
BROADCAST_LANGUAGES, BROADCAST_WORDS = 10_000, 5_000


@dataclass(frozen=True)
class Limits:
    base_words: int = 50
    repeat_percent: int = 50
    #: Words that a document must have for its histograms to be tested.
    test_words: int = 80
    #: Documents that a language must have for a reference.
    reference_docs: int = 30
    #: Share of a language's words from which on a word is common: at most 500 words a language.
    common_share: float = 0.002
    class_distance: float = 0.25
    word_distance: float = 0.66
    #: With the bin of other words. A text without any common word is at about 0.35 or more.
    rest_distance: float = 0.34


#: Windows up to this many share a long with their position.
_LOW = (1 << 20) - 1
#: Up to this many distinct repeated windows are looked up one by one.
_FEW = 32


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)).cast("int")


def with_repeats(out: DataFrame) -> DataFrame:
    """Add ``repeats``: sorted start positions of the three-word windows whose hash occurs twice or more.

    The hashes are sorted alone first, which gives those that occur twice. Texts with few of them, the usual case, look
    each window up among these. For others, up to 2**20 windows, the upper 44 bits of the hash and the position share a long, so plain longs are sorted; neighbours
    with equal upper bits are then compared in full. Longer texts sort (hash, position) pairs. Each step is a column of
    its own, since Spark would evaluate an expression inside a lambda once per element.
    """
    h, n = F.col("windows"), F.size("windows")
    out = out.withColumn("in_order", F.sort_array("windows"))
    out = out.withColumn("dups", F.array_distinct(F.filter("in_order", lambda x, i: F.coalesce(x == F.get(F.col("in_order"), i - 1), F.lit(False)))))
    few = F.size("dups") <= _FEW
    found = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("dups", F.get(h, i)))
    out = out.withColumn("found", F.when(few & (F.size("dups") > 0), found).otherwise(F.array().cast("array<int>")))
    packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long"))))
    pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))
    out = out.withColumn("packed", F.when(~few & (n <= _LOW), packed).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("pairs", F.when(~few & (n > _LOW), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:bigint>>")))
    get = lambda c, i: F.get(F.col(c), i)
    twin = lambda x, y: F.coalesce((F.shiftright(x, 20) == F.shiftright(y, 20)) & (F.get(h, _position(x)) == F.get(h, _position(y))), F.lit(False))
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    short = F.filter("packed", lambda x, i: twin(x, get("packed", i - 1)) | twin(x, get("packed", i + 1)))
    long = F.filter("pairs", lambda x, i: same(x, get("pairs", i - 1)) | same(x, get("pairs", i + 1)))
    return out.withColumn("repeats", F.when(few, F.col("found").cast("array<bigint>")).otherwise(F.sort_array(F.concat(F.transform(short, lambda x: _position(x).cast("long")), F.transform(long, lambda x: x["i"])))))


def _covered(positions: str) -> Column:
    """Words covered by three-word windows that start at these sorted positions."""
    steps = F.transform(positions, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col(positions), i + 1) - p, F.lit(3))).cast("long"))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), WORD_GAP)


def common_words(docs: DataFrame, share: float) -> DataFrame:
    """``(lang, w, share)``: the lower-case words that make up ``share`` of all words of their language, over all documents."""
    # explode_outer: with explode, Spark would filter on the size of the array and so compute the array twice
    words = docs.filter("lang IS NOT NULL").select(F.col("lang").cast("string"), F.explode_outer(_words(F.lower("text"))).alias("w")).filter("w != ''")
    counts = words.groupBy("lang", "w").agg(F.count("*").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    few = docs.select("lang").distinct().limit(BROADCAST_LANGUAGES + 1).count() <= BROADCAST_LANGUAGES
    joined = counts.filter("n > 1").join(totals.hint("broadcast" if few else "merge"), "lang")
    return joined.select("lang", "w", (F.col("n") / F.col("total")).alias("share")).filter(F.col("share") >= share)


def _class_counts(out: DataFrame) -> list[Column]:
    """``word_chars`` and counts of the classes but c_other from ``t``, ``solid`` (without white space) and ``rest`` (without lower case)."""
    length = lambda c: F.length(c).cast("long")
    less = lambda pattern: length("rest") - length(F.regexp_replace("rest", pattern, ""))
    return [
        length("solid").alias("word_chars"),
        (length("solid") - length("rest")).alias("c_lower"),
        less(r"\p{Lu}+").alias("c_upper"),
        less(r"[\p{Lo}\p{Lm}\p{Lt}]+").alias("c_caseless"),
        less(r"\p{Nd}+").alias("c_digit"),
        (length("t") - length("solid")).alias("c_space"),
        less(r"[.,;:!?'\"()\-]+").alias("c_punct"),
    ]


def _parted(docs: DataFrame, row: Column) -> DataFrame:
    out = docs.select(row.alias("row"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return out.withColumn("solid", F.translate("t", _SPACE, "")).withColumn("rest", F.regexp_replace("solid", r"\p{Ll}+", ""))


def _with_other(out: DataFrame) -> DataFrame:
    return out.withColumn("c_other", F.col("word_chars") - sum((F.col(c) for c in CLASSES if c not in ("c_space", "c_other")), F.lit(0)))


def _barrier(out: DataFrame) -> DataFrame:
    """The same rows. Spark moves no filter below a generator, so what stands above reads these columns and does not
    evaluate them again."""
    return out.select(F.inline_outer(F.array(F.struct(*out.columns))))


def references(docs: DataFrame, limits: Limits) -> DataFrame:
    """``(lang, shares of the classes, map of common words to their shares)`` of every language with enough documents."""
    counted = _parted(docs.filter("lang IS NOT NULL"), F.lit(None))
    counted = _barrier(_with_other(counted.select("lang", *_class_counts(counted))))
    total = F.nullif(sum((F.sum(c) for c in CLASSES), F.lit(0)), F.lit(0))
    classes = counted.groupBy("lang").agg(F.count("*").alias("docs"), *[(F.sum(c) / total).alias(f"r{c[1:]}") for c in CLASSES])
    words = common_words(docs, limits.common_share).groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", "share"))).alias("r_words"), F.sum("share").alias("r_common"))
    return classes.filter(F.col("docs") >= limits.reference_docs).drop("docs").join(words.hint("merge"), "lang", "left")


def profiles(docs: DataFrame, refs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Counts of every whole text, with the columns ``keep`` (all if None) of the input row as ``row`` and its reference.

    ``runs`` holds the count of each common word of the document's language with its share there.
    """
    wanted = [r["w"] for r in refs.select(F.explode(F.map_keys("r_words")).alias("w")).distinct().limit(BROADCAST_WORDS + 1).collect()]
    few = refs.count() <= BROADCAST_LANGUAGES
    out = _parted(docs, F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns])).join(refs.hint("broadcast" if few else "merge"), "lang", "left")
    r_columns = [c for c in refs.columns if c != "lang"]
    # while common words are few, a set of all languages' words is looked up before the map of the own language
    is_common = (lambda w: w.isin(wanted) if wanted else F.lit(False)) if len(wanted) <= BROADCAST_WORDS else (lambda w: F.coalesce(F.element_at("r_words", w).isNotNull(), F.lit(False)))
    out = out.withColumn("words", F.filter(F.split("t", WORD_GAP), lambda w: w != ""))
    out = out.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(3)]))).otherwise(F.array().cast("array<bigint>"))
    out = out.withColumn("windows", windows)
    size = lambda c: F.size(c).cast("long")
    length = lambda c: F.length(c).cast("long")
    out = out.select(
        "row",
        *r_columns,
        size("words").alias("n_words"),
        (length("rest") - length(F.translate("rest", "#*$%&|<>", ""))).alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        "windows",
        *_class_counts(out),
        F.sort_array(F.filter(F.split(F.lower("t"), WORD_GAP), is_common)).alias("common"),
    )
    out = with_repeats(_with_other(out))
    starts = F.filter(F.sequence(F.lit(0), F.size("common") - 1), lambda i: F.coalesce(F.get(F.col("common"), i) != F.get(F.col("common"), i - 1), F.lit(True)))
    out = out.withColumn("starts", F.when(F.size("common") > 0, starts).otherwise(F.array().cast("array<int>")))
    share = lambda w: F.element_at("r_words", w)
    runs = F.transform("starts", lambda i, k: F.struct((F.coalesce(F.get(F.col("starts"), k + 1), F.size("common")) - i).alias("c"), share(F.get(F.col("common"), i)).alias("q")))
    out = out.withColumn("runs", runs)
    return out.select("row", *r_columns, "n_words", "word_chars", "n_symbols", "n_dup_lines", _covered("repeats").alias("n_repeat_words"), *CLASSES, F.filter("runs", lambda x: x["q"].isNotNull()).alias("runs"))


def _term(p: Column, q: Column) -> Column:
    """What one bin adds to twice the Jensen-Shannon divergence, in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
    return part(p) + part(q)


def with_distances(made: DataFrame) -> DataFrame:
    """Add the three distances to rows of profiles; null without a reference. ``made`` is evaluated once."""
    out = _barrier(made).withColumn("n_common", F.aggregate("runs", F.lit(0).cast("long"), lambda a, x: a + x["c"]))
    out = _barrier(out.withColumn("n_common", F.when(F.col("r_words").isNotNull(), F.col("n_common"))))
    total = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    chars = F.nullif(sum((F.col(c) for c in CLASSES), F.lit(0)), F.lit(0)).cast("double")
    classes = sum((_term(F.col(c) / chars, F.col(f"r{c[1:]}")) for c in CLASSES), F.lit(0.0))
    # bins that the document lacks add their whole reference share; a text without common words shares no bin
    of = lambda n, q: F.aggregate("runs", F.lit(0.0), lambda a, x: a + _term(x["c"] / n, x["q"] / q) - x["q"] / q)
    root = lambda x: F.sqrt(F.greatest(F.lit(0.0), x / 2))
    words = F.when(F.col("n_common") > 0, root(of(F.col("n_common").cast("double"), F.col("r_common")) + 1.0)).otherwise(1.0)
    rest = root(of(total, F.lit(1.0)) + F.col("r_common") + _term(1 - F.col("n_common") / total, F.greatest(F.lit(0.0), 1 - F.col("r_common"))))
    known = F.col("r_words").isNotNull()
    out = out.withColumn("class_distance", F.when(F.col("r_lower").isNotNull(), root(classes)))
    return _barrier(out.withColumn("word_distance", F.when(known, words)).withColumn("rest_distance", F.when(known, rest)).drop("runs", "r_words"))


def judged(docs: DataFrame, limits: Limits = Limits(), keep: list[str] | None = None) -> DataFrame:
    """Profiles with ``class_distance``, ``word_distance``, ``rest_distance`` (null if not tested), ``base_failed`` and ``kept``.

    ``docs`` needs text and lang. Null and empty texts have no words and fail the base rule. Only the base rule
    judges documents of fewer than ``test_words`` words, without a language, or of a language with fewer than ``reference_docs``
    documents; a language without common words has its classes tested alone. Repeated rows are judged
    each; an empty table gives no rows; the columns ``keep`` (all if None) stay in ``row``, whatever their names.
    """
    out = with_distances(profiles(docs, written(references(docs, limits), "references"), keep))
    tested = F.col("n_words") >= limits.test_words
    base = (F.col("n_words") < limits.base_words) | (100 * F.col("n_repeat_words") > limits.repeat_percent * F.col("n_words"))
    most = {"class_distance": limits.class_distance, "word_distance": limits.word_distance, "rest_distance": limits.rest_distance}
    for name in most:
        out = out.withColumn(name, F.when(tested, F.col(name)))
    far = F.lit(False)
    for name, value in most.items():
        far = far | (F.coalesce(F.col(name), F.lit(0.0)) > value)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *CLASSES, "n_common", *most]
    return out.select("row", *counts, base.alias("base_failed"), (~base & ~far).alias("kept"))


def op6_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *[F.round(c, 6).alias(c) for c in ("class_distance", "word_distance", "rest_distance")])


def good_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's form: rows that are kept, with the columns they came with."""
    return judged(docs).filter("kept").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_GAP = r"'[\x20\x09-\x0D]+'"
_PUNCT = """'[.,;:!?''"()\\-]+'"""
_L = Limits()


def _sql_less(pattern: str) -> str:
    return f"len(solid) - len(regexp_replace(solid, {pattern}, '', 'g'))"


def _sql_term(p: str, q: str) -> str:
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2(2 * {x} / ({p} + {q})) ELSE 0.0 END"
    return f"({part(p)} + {part(q)})"


OP6_SQL = f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), {_GAP}, '', 'g') AS solid FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, {_GAP}), lambda x: x <> '') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
b AS (SELECT doc_id, lang, words, len(words) AS n_words, len(solid) AS word_chars, {_sql_less("'[#*$%&|<>]+'")} AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, {_sql_less(r"'[\p{Ll}]+'")} AS c_lower, {_sql_less(r"'[\p{Lu}]+'")} AS c_upper,
             {_sql_less(r"'[\p{Lo}\p{Lm}\p{Lt}]+'")} AS c_caseless, {_sql_less(r"'[\p{Nd}]+'")} AS c_digit, len(t) - len(solid) AS c_space,
             {_sql_less(_PUNCT)} AS c_punct FROM w),
c AS (SELECT *, word_chars - c_lower - c_upper - c_caseless - c_digit - c_punct AS c_other FROM b),
x AS (SELECT doc_id, unnest(range(1, n_words - 1)) AS i, words FROM c WHERE n_words >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i], words[i + 1], words[i + 2]) AS k FROM x),
r AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM y WHERE k > 1) GROUP BY doc_id),
u AS (SELECT doc_id, lang, lower(unnest(words)) AS w FROM c),
n AS (SELECT lang, w, count(*) AS n FROM u WHERE lang IS NOT NULL GROUP BY lang, w),
s AS (SELECT lang, w, n / total AS share FROM n JOIN (SELECT lang, sum(n) AS total FROM n GROUP BY lang) USING (lang) WHERE n > 1 AND n / total >= {_L.common_share}::DOUBLE),
e AS (SELECT lang, sum(share) AS r_common, count(*) AS bins FROM s GROUP BY lang),
l AS (SELECT lang, {", ".join(f"sum({c})::DOUBLE / sum({' + '.join(CLASSES)}) AS r{c[1:]}" for c in CLASSES)} FROM c WHERE lang IS NOT NULL
      GROUP BY lang HAVING count(*) >= {_L.reference_docs}),
d AS (SELECT doc_id, u.lang, u.w, count(*) AS c, any_value(share) AS q FROM u JOIN s ON u.lang = s.lang AND u.w = s.w GROUP BY doc_id, u.lang, u.w),
m AS (SELECT doc_id, sum(c) AS n_common FROM d GROUP BY doc_id),
g AS (SELECT d.doc_id, sum({_sql_term("(c / n_common::DOUBLE)", "(q / r_common)")} - q / r_common) AS s_words,
             sum({_sql_term("(c / n_words::DOUBLE)", "q")} - q) AS s_rest
      FROM d JOIN m USING (doc_id) JOIN e ON d.lang = e.lang JOIN (SELECT doc_id, n_words FROM c) USING (doc_id) GROUP BY d.doc_id),
j AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, l.lang IS NOT NULL AND n_words >= {_L.test_words} AS tested,
             e.lang IS NOT NULL AS worded, coalesce(n_common, 0) AS n_common, r_common, coalesce(s_words, 0) AS s_words, coalesce(s_rest, 0) AS s_rest,
             {" + ".join(_sql_term(f"({c} / (word_chars + c_space)::DOUBLE)", f"r{c[1:]}") for c in CLASSES)} AS s_class
      FROM c LEFT JOIN r USING (doc_id) LEFT JOIN l ON c.lang = l.lang LEFT JOIN e ON c.lang = e.lang LEFT JOIN m USING (doc_id) LEFT JOIN g USING (doc_id)),
k AS (SELECT *, n_words < {_L.base_words} OR 100 * n_repeat_words > {_L.repeat_percent} * n_words AS base_failed,
             CASE WHEN tested THEN sqrt(greatest(0.0, s_class / 2)) END AS dc,
             CASE WHEN tested AND worded THEN CASE WHEN n_common > 0 THEN sqrt(greatest(0.0, (s_words + 1.0) / 2)) ELSE 1.0 END END AS dw,
             CASE WHEN tested AND worded THEN sqrt(greatest(0.0, (s_rest + r_common + {_sql_term("(1 - n_common / n_words::DOUBLE)", "greatest(0.0, 1 - r_common)")}) / 2)) END AS dr FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND coalesce(dc, 0) <= {_L.class_distance} AND coalesce(dw, 0) <= {_L.word_distance} AND coalesce(dr, 0) <= {_L.rest_distance} AS kept,
       round(dc, 6) AS class_distance, round(dw, 6) AS word_distance, round(dr, 6) AS rest_distance FROM k
"""
