"""Scalar functions (B1-B26): identifiers, titles, hashes, bibliography text and payload fields, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_space(c: Column) -> Column:
    """Without Unicode white space at both ends (Spark's trim takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_doi(c: Column) -> Column:
    """B1: lower case, without resolver prefixes and stray punctuation at the ends."""
    out = strip_space(F.lower(_text(c)))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = F.regexp_replace(out, "^" + prefix.replace(".", r"\."), "")
    return F.regexp_replace(strip_space(out), r"^[ .;,)]+|[ .;,)]+$", "")


def normalize_arxiv_id(c: Column) -> Column:
    """B2: the part after the last slash, without ``arxiv:`` and a trailing version."""
    out = F.regexp_replace(strip_space(F.lower(_text(c))), r"(?s)^.*/", "")
    return F.regexp_replace(F.regexp_replace(out, r"^arxiv:", ""), r"(?<=.)v[0-9]+$", "")


def normalize_title(c: Column) -> Column:
    """Lower-case letters and digits, everything else one space. Also used for author names."""
    return F.trim(F.regexp_replace(F.lower(_text(c)), r"[^\p{L}\p{N}]+", " "))


def title_year_key(title: Column, year: Column) -> Column:
    """Empty without a title or a positive year."""
    t = normalize_title(title)
    return F.when((t != "") & (F.coalesce(year, F.lit(0)) > 0), F.concat(F.lit("title:"), t, F.lit(":"), year.cast("string"))).otherwise("")


def identity_keys(doi: Column, arxiv_id: Column, source: Column, external_id: Column) -> Column:
    """Keys in order of trust; the source's own id only where no global one exists."""
    key = lambda kind, v: F.when(v != "", F.concat(F.lit(kind), v))
    both = F.filter(F.array(key("doi:", normalize_doi(doi)), key("arxiv:", normalize_arxiv_id(arxiv_id))), lambda x: x.isNotNull())
    own = F.concat(F.lit("source:"), F.lower(_text(source)), F.lit(":"), strip_space(F.lower(_text(external_id))))
    return F.when(F.size(both) > 0, both).when(strip_space(_text(external_id)) != "", F.array(own)).otherwise(F.array().cast("array<string>"))


def clean_abstract(c: Column) -> Column:
    """B6."""
    return strip_space(F.replace(c, F.lit("\n"), F.lit(" ")))


def id_from_url(c: Column) -> Column:
    """The last path segment."""
    return F.substring_index(c, "/", -1)


def filename_from_url(c: Column) -> Column:
    """The last path segment as a ``.pdf`` name; empty without a slash."""
    name = id_from_url(c)
    return F.when(~F.contains(c, F.lit("/")), "").when(F.endswith(name, F.lit(".pdf")), name).otherwise(F.concat(name, F.lit(".pdf")))


def pick_pdf_url(links: Column, entry_id: Column) -> Column:
    """First link titled ``pdf`` or ending in ``.pdf``, else one built from the id."""
    hit = F.get(F.filter(links, lambda x: (x["title"] == "pdf") | F.endswith(x["href"], F.lit(".pdf"))), 0)
    return F.coalesce(hit["href"], F.concat(F.lit("https://arxiv.org/pdf/"), id_from_url(entry_id), F.lit(".pdf")))


def pick_abstract_url(links: Column, entry_id: Column) -> Column:
    """First alternate HTML link, else the entry's id."""
    hit = F.get(F.filter(links, lambda x: (x["rel"] == "alternate") & (x["type"] == "text/html")), 0)
    return F.coalesce(hit["href"], entry_id)


def field_or_empty(struct: Column, name: str) -> Column:
    """A field of a struct that may be null."""
    return F.coalesce(struct[name].cast("string"), F.lit(""))


def category_terms(categories: Column) -> Column:
    """B9."""
    return F.transform(categories, lambda x: x["term"])


def published_year(c: Column) -> Column:
    """Year of an RFC 3339 time, 0 if it is none."""
    return F.coalesce(F.year(F.try_to_timestamp(c)), F.lit(0))


def year_to_date(c: Column) -> Column:
    return F.when(c > 0, F.make_date(c, F.lit(1), F.lit(1)))


def date_to_year(c: Column) -> Column:
    return F.coalesce(F.year(c), F.lit(0))


def truncate_chars(c: Column, n: int) -> Column:
    """The first n code points."""
    return F.substring(c, 1, n)


def truncate_bytes(c: Column, n: int) -> Column:
    """The first n bytes, as binary."""
    return F.substring(F.encode(c, "utf-8"), 1, n)


def null_if_empty(c: Column) -> Column:
    """B12."""
    return F.nullif(c, F.lit(""))


def empty_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def score_or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def content_hash(c: Column) -> Column:
    """Lower-case hex SHA-256."""
    return F.sha2(c, 256)


def identity_string(provider: Column, model: Column, dimensions: Column, instruction: Column, indexing: Column) -> Column:
    """B14."""
    return F.concat_ws(":", provider, model, dimensions.cast("string"), instruction, indexing)


def collection_suffix(provider: Column, model: Column, dimensions: Column, identity: Column) -> Column:
    """Readable part, dimension, and eight hex digits of the identity's hash."""
    name = F.regexp_replace(F.translate(F.lower(F.concat_ws("_", provider, model)), "/:.-", "____"), "^_+|_+$", "")
    return F.concat_ws("_", name, dimensions.cast("string"), F.substring(F.sha2(identity, 256), 1, 8))


def collection_name(prefix: Column, suffix: Column, generation: Column) -> Column:
    return F.concat_ws("_", prefix, suffix, generation)


#: Fixed value: the URL namespace of RFC 4122.
_URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """Version-5 UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(_URL_NAMESPACE)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def point_id(topic: Column, paper: Column, kind: Column, index: Column, digest: Column, identity: Column) -> Column:
    """The deterministic id of a chunk's vector."""
    return uuid5(F.concat_ws(":", topic.cast("string"), paper.cast("string"), kind, index.cast("string"), digest, identity))


def author_key(c: Column) -> Column:
    """The storage key (spaces only, as SQL btrim)."""
    return F.lower(F.trim(c))


def valid_uuid(c: Column) -> Column:
    """B17."""
    return F.coalesce(c.rlike("^[0-9a-fA-F]{8}-([0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$"), F.lit(False))


def valid_topic(c: Column) -> Column:
    """Required, 10 to 500 characters."""
    return F.coalesce(F.char_length(c).between(10, 500), F.lit(False))


def word_list(c: Column) -> Column:
    """Words by Unicode white space."""
    return F.filter(F.split(_text(c), r"(?U)\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    """B18."""
    return F.size(word_list(c))


def trailing_words(c: Column, n: int) -> Column:
    """The last n words, joined by one space."""
    if n <= 0:
        return F.lit("")
    w = word_list(c)
    return F.array_join(F.slice(w, F.greatest(F.size(w) - n, F.lit(0)) + 1, F.lit(n)), " ")


def format_evidence(c: Column) -> Column:
    """``a, b`` -> ``[@a; @b]``."""
    keys = F.filter(F.transform(F.split(_text(c), ","), strip_space), lambda k: k != "")
    cited = F.concat(F.lit("["), F.array_join(F.transform(keys, lambda k: F.concat(F.lit("@"), k)), "; "), F.lit("]"))
    return F.when(F.size(keys) > 0, cited).otherwise("Not specified")


#: Escaped signs wait on private code points while commands and braces are dropped.
_ESCAPED = "\\{}%&#$_^~"
_PARKED = "".join(chr(0xE000 + i) for i in range(len(_ESCAPED)))


def flatten_tex(c: Column) -> Column:
    """TeX to plain text; each inner white-space sign becomes one space. Only texts with a backslash go through the
    replacements of escapes and commands."""
    tex = _text(c)
    for sign, park in zip(_ESCAPED, _PARKED, strict=True):
        tex = F.replace(tex, F.lit("\\" + sign), F.lit(park))
    spaced = lambda x: F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)[\s&&[^ ]]", " ")
    tex = F.regexp_replace(spaced(tex), r"\\LaTeX(?![A-Za-z])", "LaTeX")
    tex = F.regexp_replace(tex, r"\\TeX(?![A-Za-z])", "TeX")
    tex = F.regexp_replace(tex, r"\\(ldots|dots)(?![A-Za-z])", "…")
    tex = F.regexp_replace(F.regexp_replace(tex, r"\\[A-Za-z]+", ""), r"\\(.)", "$1")
    out = F.when(F.contains(_text(c), F.lit("\\")), tex).otherwise(spaced(_text(c)))
    for sign, text in (("{", ""), ("}", ""), *zip(_PARKED, _ESCAPED, strict=True)):
        out = F.replace(out, F.lit(sign), F.lit(text))
    return strip_space(out)


def sanitize_bibtex(c: Column) -> Column:
    """Flattened, then special signs escaped. Whole texts are replaced, sign by sign; a backslash waits on a private code point,
    of which a flattened text has none, while the signs whose escapes have braces or backslashes are replaced."""
    out = F.replace(flatten_tex(c), F.lit("\\"), F.lit(_PARKED[0]))
    for sign in "{}%&#$_":
        out = F.replace(out, F.lit(sign), F.lit("\\" + sign))
    for sign, text in (("^", r"\textasciicircum{}"), ("~", r"\textasciitilde{}"), (_PARKED[0], r"\textbackslash{}")):
        out = F.replace(out, F.lit(sign), F.lit(text))
    return out


def bibtex_type(arxiv_id: Column, venue: Column) -> Column:
    """B22."""
    v = F.lower(_text(venue))
    blank = strip_space(v) == ""
    return (
        F.when((strip_space(_text(arxiv_id)) != "") & blank, "misc")
        .when(v.rlike("conference|proceedings|workshop|symposium"), "inproceedings")
        .when(~blank, "article")
        .otherwise("misc")
    )


def unfence_json(c: Column) -> Column:
    """Valid JSON as it is, or the inside of exactly one fence; null if neither."""
    whole = strip_space(_text(c))
    inner = F.regexp_extract(whole, r"(?s)^```(?:json)?\s*\n(.*?)\n?\s*```$", 1)
    ok = lambda x: F.try_parse_json(x).isNotNull() & (x != "")
    return F.when(ok(whole), whole).when(~F.contains(inner, F.lit("```")) & ok(inner), strip_space(inner))


#: HTTP statuses worth another try, of the web clients and of the model client.
HTTP_RETRY = [408, 425, 429, 500, 502, 503, 504]
MODEL_RETRY = [408, 429, 500, 502, 503, 504]


def is_retryable(status: Column, timed_out: Column, statuses: list[int] = HTTP_RETRY) -> Column:
    """B24."""
    return F.coalesce(timed_out, F.lit(False)) | F.coalesce(status.isin(statuses), F.lit(False))


def backoff_ms(attempt: Column, base: int, most: int) -> Column:
    """Base * 2**attempt, at most ``most``; jitter is left to the caller."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(most))).cast("long")


def retry_after_ms(header: Column, now: Column) -> Column:
    """Seconds, or an HTTP date after ``now``; else 0."""
    seconds = header.try_cast("long") * 1000
    when = F.try_to_timestamp(F.regexp_extract(header, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(seconds, F.unix_millis(when) - F.unix_millis(now), F.lit(0))
    return F.greatest(wait, F.lit(0)).cast("long")


def job_field(payload: Column, key: str, kind: str = "string") -> Column:
    """A typed field of a free-form payload; null for another type."""
    return F.try_variant_get(F.try_parse_json(payload), f"$.{key}", kind)
