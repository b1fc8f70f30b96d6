"""Queries of the scalar functions (B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .views import PAPERS, papers, table


def normalize_titles(spark: SparkSession, sf: str) -> DataFrame:
    return papers(spark, sf).select("paper_id", T.normalize_title(F.col("title")).alias("norm"), T.title_year_key(F.col("title"), F.col("year")).alias("key"))


def _raw_ids() -> tuple:
    raw = F.when(F.col("paper_id") % 3 == 0, F.concat(F.lit(" HTTPS://doi.org/"), F.col("doi"), F.lit(").,"))).when(F.col("paper_id") % 3 == 1, F.concat(F.lit("doi:"), F.col("doi"))).otherwise(F.col("doi"))
    arx = F.when(F.col("paper_id") % 2 == 0, F.concat(F.lit("http://arxiv.org/abs/2401."), F.col("external_id"), F.lit("v2"))).otherwise(F.concat(F.lit("arXiv:2401."), F.col("external_id")))
    return raw, arx


_RAW = """raw AS (SELECT *, CASE paper_id % 3 WHEN 0 THEN ' HTTPS://doi.org/' || doi || ').,' WHEN 1 THEN 'doi:' || doi ELSE doi END AS rd,
  CASE WHEN paper_id % 2 = 0 THEN 'http://arxiv.org/abs/2401.' || external_id || 'v2' ELSE 'arXiv:2401.' || external_id END AS ra FROM papers)"""


def normalize_ids(spark: SparkSession, sf: str) -> DataFrame:
    raw, arx = _raw_ids()
    return papers(spark, sf).select("paper_id", T.normalize_doi(raw).alias("doi"), T.normalize_arxiv_id(arx).alias("arxiv_id"))


def identity_keys(spark: SparkSession, sf: str) -> DataFrame:
    raw, arx = _raw_ids()
    p = papers(spark, sf).select("paper_id", "source", "external_id", F.when(F.col("paper_id") % 4 < 2, raw).alias("rd"), F.when(F.col("paper_id") % 4 == 1, arx).alias("ra"))
    return p.select("paper_id", F.array_join(T.identity_keys(F.col("rd"), F.col("ra"), F.col("source"), F.col("external_id")), "|").alias("keys"))


def source_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    url = F.concat(F.lit("http://arxiv.org/abs/"), F.col("external_id"))
    pdf = F.struct(F.concat(F.lit("http://x/"), F.col("external_id"), F.lit(".pdf")).alias("href"), F.lit("").alias("title"), F.lit("related").alias("rel"), F.lit("application/pdf").alias("type"))
    page = F.struct(F.concat(F.lit("http://x/"), F.col("external_id")).alias("href"), F.lit("").alias("title"), F.lit("alternate").alias("rel"), F.lit("text/html").alias("type"))
    links = F.when(F.col("paper_id") % 3 == 0, F.array(page, pdf)).otherwise(F.array(page))
    ids = F.when(F.col("paper_id") % 2 == 0, F.struct(F.col("doi").alias("DOI")))
    own = p.select("paper_id", url.alias("url"), links.alias("links"), ids.alias("ids"), "abstract")
    return own.select("paper_id", T.pick_pdf_url(F.col("links"), F.col("url")).alias("pdf_url"), T.pick_abstract_url(F.col("links"), F.col("url")).alias("page_url"), T.field_or_empty(F.col("ids"), "DOI").alias("doi"), F.sha2(T.clean_abstract(F.col("abstract")), 256).alias("abstract_hash"))


def author_keys(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    name = F.when(F.col("c_custkey") % 2 == 1, F.concat(F.lit("  "), F.upper("c_name"), F.lit(" "))).otherwise(F.col("c_name"))
    return c.select("c_custkey", T.author_key(name).alias("key"), T.normalize_title(name).alias("dedup_key"))


def text_scalars(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    url = F.concat(F.lit("https://host/files/"), F.col("external_id"), F.when(F.col("paper_id") % 2 == 0, ".pdf").otherwise(""))
    when = F.when(F.col("paper_id") % 5 == 0, F.lit("not a date")).otherwise(F.concat(F.col("year").cast("string"), F.lit("-03-01T00:00:00Z")))
    return p.select(
        "paper_id",
        T.id_from_url(url).alias("segment"),
        T.filename_from_url(url).alias("file_name"),
        T.published_year(when).alias("published"),
        T.year_to_date(F.col("year")).cast("string").alias("day"),
        T.truncate_chars(F.col("title"), 20).alias("short"),
        F.length(T.truncate_bytes(F.col("title"), 15)).alias("short_bytes"),
        T.valid_topic(F.col("title")).alias("topic_ok"),
        T.word_count(F.col("title")).alias("words"),
        T.trailing_words(F.col("title"), 3).alias("tail"),
        T.format_evidence(F.when(F.col("paper_id") % 3 == 0, F.lit(" , ")).otherwise(F.concat_ws(",", F.lit(" a"), F.col("external_id")))).alias("evidence"),
        T.bibtex_type(F.when(F.col("source") == "arxiv", F.col("external_id")), F.col("venue")).alias("kind"),
        T.empty_if_null(F.col("venue")).alias("venue"),
        T.valid_uuid(T.uuid5(F.col("external_id"))).alias("uuid_ok"),
    )


_TEXT_SQL = f"""WITH {PAPERS}, t AS (SELECT *, list_filter(regexp_split_to_array(title, '[ \\n]+'), lambda w: w <> '') AS w,
  'https://host/files/' || external_id || CASE WHEN paper_id % 2 = 0 THEN '.pdf' ELSE '' END AS url FROM papers)
SELECT paper_id, split_part(url, '/', -1) AS segment, CASE WHEN paper_id % 2 = 0 THEN external_id || '.pdf' ELSE external_id || '.pdf' END AS file_name,
  CASE WHEN paper_id % 5 = 0 THEN 0 ELSE year END AS published, year::VARCHAR || '-01-01' AS day, substr(title, 1, 20) AS short,
  least(15, octet_length(encode(title)))::INT AS short_bytes, length(title) BETWEEN 10 AND 500 AS topic_ok, len(w)::INT AS words,
  array_to_string(list_slice(w, greatest(len(w) - 2, 1), len(w)), ' ') AS tail,
  CASE WHEN paper_id % 3 = 0 THEN 'Not specified' ELSE '[@a; @' || external_id || ']' END AS evidence,
  CASE WHEN venue IS NULL THEN 'misc' WHEN lower(venue) LIKE '%proceedings%' THEN 'inproceedings' ELSE 'article' END AS kind,
  coalesce(venue, '') AS venue, true AS uuid_ok FROM t"""


def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    ident = T.identity_string(F.lit("ollama"), F.lit("qwen3-embedding:8b"), F.lit(4096), F.lit("qwen-v1"), F.lit("v1"))
    d = table(spark, sf, "documents")
    suffix = T.collection_suffix(F.lit("ollama"), F.lit("qwen3-embedding:8b"), F.lit(4096), ident)
    return d.select("doc_id", T.content_hash(F.col("text")).alias("hash"), T.collection_name(F.lit("papers"), suffix, F.col("source")).alias("collection"))


def point_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select("doc_id", T.point_id(F.col("source"), F.col("doc_id"), F.lit("abstract"), F.lit(0), T.content_hash(F.col("text")), F.lit("id")).alias("point_id"))


_POINT_SQL = """WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(source || ':' || doc_id || ':abstract:0:' || sha256(text) || ':id')) AS h FROM documents)
SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS point_id FROM h"""


def bibtex_fields(spark: SparkSession, sf: str) -> DataFrame:
    seeds = F.concat(F.lit(r"{\LaTeX} \emph{on} 50\% of A\&B_x "), F.col("title"), F.lit(r" \ldots"))
    p = papers(spark, sf)
    return p.select("paper_id", T.flatten_tex(seeds).alias("flat"), T.sanitize_bibtex(seeds).alias("safe"))


def fence_json(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    body = F.to_json(F.struct(F.col("turn").alias("turn"), F.length("text").alias("n")))
    raw = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("conv_id") % 11 == 0, F.substring(body, 1, 6)).otherwise(body)
    out = c.select("conv_id", "turn", T.unfence_json(raw).alias("json"))
    return out.select("conv_id", "turn", F.col("json").isNotNull().alias("ok"), F.get_json_object("json", "$.n").cast("int").alias("n"))


def job_fields(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", T.job_field(F.col("props"), "k", "int").alias("k"), T.job_field(F.col("props"), "missing").alias("missing"))


def retry_classes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.lit(400) + F.col("event_id") % 110).cast("int").alias("status"), (F.col("event_type") == "error").alias("timeout"))
    return e.select("event_id", T.is_retryable(F.col("status"), F.col("timeout")).alias("http"), T.is_retryable(F.col("status"), F.col("timeout"), T.MODEL_RETRY).alias("model"))


def backoff(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % 8).alias("attempt"), F.when(F.col("event_id") % 3 == 0, "7").when(F.col("event_id") % 3 == 1, "Wed, 21 Oct 2026 07:28:00 GMT").otherwise("soon").alias("header"))
    now = F.to_timestamp(F.lit("2026-10-21 07:27:00"))
    return e.select("event_id", T.backoff_ms(F.col("attempt"), 500, 10_000).alias("wait"), T.retry_after_ms(F.col("header"), now).alias("after"))


QUERIES = {
    "normalize_titles": (normalize_titles, f"WITH {PAPERS}, n AS (SELECT *, trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) AS norm FROM papers) SELECT paper_id, norm, CASE WHEN norm <> '' THEN 'title:' || norm || ':' || year ELSE '' END AS key FROM n"),
    "normalize_ids": (normalize_ids, f"WITH {PAPERS}, {_RAW} SELECT paper_id, '10.1000/' || external_id AS doi, regexp_replace(regexp_replace(regexp_replace(lower(ra), '^.*/', ''), '^arxiv:', ''), '(.)v[0-9]+$', '\\1') AS arxiv_id FROM raw"),
    "identity_keys": (identity_keys, f"WITH {PAPERS} SELECT paper_id, CASE paper_id % 4 WHEN 0 THEN 'doi:10.1000/' || external_id WHEN 1 THEN 'doi:10.1000/' || external_id || '|arxiv:2401.' || external_id ELSE 'source:' || source || ':' || external_id END AS keys FROM papers"),
    "source_fields": (source_fields, f"WITH {PAPERS} SELECT paper_id, CASE WHEN paper_id % 3 = 0 THEN 'http://x/' || external_id || '.pdf' ELSE 'https://arxiv.org/pdf/' || external_id || '.pdf' END AS pdf_url, 'http://x/' || external_id AS page_url, CASE WHEN paper_id % 2 = 0 THEN doi ELSE '' END AS doi, sha256(regexp_replace(replace(abstract, chr(10), ' '), '^\\s+|\\s+$', '', 'g')) AS abstract_hash FROM papers"),
    "author_keys": (author_keys, "SELECT c_custkey, lower(trim(c_name)) AS key, trim(regexp_replace(lower(c_name), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS dedup_key FROM customer"),
    "text_scalars": (text_scalars, _TEXT_SQL),
    "content_hashes": (content_hashes, "SELECT doc_id, sha256(text) AS hash, 'papers_ollama_qwen3_embedding_8b_4096_' || substr(sha256('ollama:qwen3-embedding:8b:4096:qwen-v1:v1'), 1, 8) || '_' || source AS collection FROM documents"),
    "point_ids": (point_ids, _POINT_SQL),
    "bibtex_fields": (bibtex_fields, None),
    "fence_json": (fence_json, "SELECT conv_id, turn, NOT (conv_id % 5 <> 0 AND conv_id % 11 = 0) AS ok, CASE WHEN conv_id % 5 <> 0 AND conv_id % 11 = 0 THEN NULL ELSE length(text) END::INT AS n FROM conversations"),
    "job_fields": (job_fields, "SELECT event_id, (props::JSON->>'k')::INT AS k, NULL::VARCHAR AS missing FROM events"),
    "retry_classes": (retry_classes, "SELECT event_id, event_type = 'error' OR (400 + event_id % 110) IN (408, 425, 429, 500, 502, 503, 504) AS http, event_type = 'error' OR (400 + event_id % 110) IN (408, 429, 500, 502, 503, 504) AS model FROM events"),
    "backoff": (backoff, "SELECT event_id, least(500 * 2 ** (event_id % 8), 10000)::BIGINT AS wait, CASE event_id % 3 WHEN 0 THEN 7000 WHEN 1 THEN 60000 ELSE 0 END::BIGINT AS after FROM events"),
}
