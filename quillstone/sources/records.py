"""Sources (A1-A9): search payloads, feeds, binaries and converted documents as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import category_terms, field_or_empty, id_from_url, pick_abstract_url, pick_pdf_url, published_year, strip_space, truncate_bytes

SEARCH = (
    "total int, offset int, next int, data array<struct<paperId:string,title:string,abstract:string,url:string,year:int,venue:string,"
    "openAccessPdf:struct<url:string>,externalIds:struct<DOI:string,ArXiv:string>,authors:array<struct<authorId:string,name:string>>,"
    "references:array<struct<paperId:string>>>>"
)
ATOM = (
    "entry array<struct<id:string,title:string,summary:string,published:string,doi:string,journal_ref:string,author:array<struct<name:string>>,"
    "link:array<struct<_href:string,_rel:string,_title:string,_type:string>>,category:array<struct<_term:string>>>>"
)


def read_search_json(payloads: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """A1: one row per hit, with its place in the response."""
    parsed = payloads.select(*keys, F.from_json(column, SEARCH).alias("r"))
    return parsed.select(*keys, F.posexplode("r.data").alias("position", "hit"))


def read_atom_xml(payloads: DataFrame, keys: list[str], column: str = "payload") -> DataFrame:
    """A2: one row per entry; namespaces are ignored, so elements match by local name."""
    parsed = payloads.select(*keys, F.from_xml(column, ATOM, {"ignoreNamespace": "true"}).alias("r"))
    return parsed.select(*keys, F.posexplode("r.entry").alias("position", "entry"))


def lookup_by_ids(records: DataFrame, ids: DataFrame) -> DataFrame:
    """A3: the records of ``ids(id)``; an id without one gives a row with an error."""
    found = ids.select("id").distinct().join(records.withColumn("_there", F.lit(True)), "id", "left")
    return found.withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("no record for "), "id"))).drop("_there")


def build_search_expr(topic: Column, keywords: Column) -> Column:
    """A4."""
    words = F.filter(F.transform(keywords, lambda k: strip_space(k)), lambda k: k != "")
    return F.concat_ws(" AND ", F.transform(F.concat(F.array(topic), words), lambda k: F.concat(F.lit("all:"), k)))


def unify_search(hits: DataFrame, keys: list[str]) -> DataFrame:
    """A5: the common record of a JSON hit; the external id is the paper id."""
    h = F.col("hit")
    authors = F.transform(h["authors"], lambda a: F.struct(a["name"].alias("name"), a["authorId"].alias("author_id")))
    return hits.select(*keys, "position", h["paperId"].alias("id"), h["title"].alias("title"), F.coalesce(h["abstract"], F.lit("")).alias("abstract"), F.lit("semantic_scholar").alias("source"), h["paperId"].alias("external_id"), F.coalesce(h["url"], F.lit("")).alias("url"), field_or_empty(h["openAccessPdf"], "url").alias("pdf_url"), F.coalesce(h["year"], F.lit(0)).alias("year"), F.coalesce(h["venue"], F.lit("")).alias("venue"), field_or_empty(h["externalIds"], "DOI").alias("doi"), field_or_empty(h["externalIds"], "ArXiv").alias("arxiv_id"), authors.alias("authors"))


def unify_atom(entries: DataFrame, keys: list[str]) -> DataFrame:
    """A5: the common record of a feed entry; the external id is the arXiv id, there is no venue."""
    e = F.col("entry")
    links = F.transform(e["link"], lambda x: F.struct(x["_href"].alias("href"), x["_rel"].alias("rel"), F.coalesce(x["_title"], F.lit("")).alias("title"), F.coalesce(x["_type"], F.lit("")).alias("type")))
    own = id_from_url(e["id"])
    authors = F.transform(e["author"], lambda a: F.struct(a["name"].alias("name"), F.lit(None).cast("string").alias("author_id")))
    return entries.select(*keys, "position", own.alias("id"), strip_space(e["title"]).alias("title"), strip_space(F.replace(F.coalesce(e["summary"], F.lit("")), F.lit("\n"), F.lit(" "))).alias("abstract"), F.lit("arxiv").alias("source"), own.alias("external_id"), pick_abstract_url(links, e["id"]).alias("url"), pick_pdf_url(links, e["id"]).alias("pdf_url"), published_year(e["published"]).alias("year"), F.lit("").alias("venue"), F.coalesce(e["doi"], F.lit("")).alias("doi"), own.alias("arxiv_id"), authors.alias("authors"))


def entry_categories(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.select(*keys, "position", category_terms(F.transform(F.col("entry.category"), lambda c: F.struct(c["_term"].alias("term")))).alias("categories"))


#: Media types a PDF may come with.
PDF_TYPES = ["", "application/pdf", "application/octet-stream"]


def binary_fault(content: Column, media_type: Column, declared: Column, most: int = 50 << 20, signature: str = "%PDF-") -> Column:
    """Why a downloaded file is refused; null if it is accepted."""
    kind = F.trim(F.lower(F.split_part(F.coalesce(media_type, F.lit("")), F.lit(";"), F.lit(1))))
    head = F.substring(content, 1, 1024)
    return (
        F.when(~kind.isin(PDF_TYPES), "media type")
        .when(F.coalesce(declared, F.lit(0)) > most, "declared size")
        .when(F.octet_length(content) > most, "size")
        .when(~F.contains(head, F.lit(signature).cast("binary")), "signature")
    )


def useful_chars(markdown: Column) -> Column:
    """Characters that are not white space or Markdown marks."""
    return F.length(F.translate(F.coalesce(markdown, F.lit("")), " \t\r\n#*_`-", ""))


def classify_conversion(status: Column, useful: Column, ocr_useful: Column, policy: str = "fallback") -> Column:
    """``ok``, ``ocr``, ``rejected``, ``partial``, ``error`` or ``unknown``. Unusable text is rejected under every policy;
    under ``fallback`` a usable text read by OCR stands in for it. A null status is unknown."""
    second = F.coalesce(ocr_useful, F.lit(False)) if policy == "fallback" else F.lit(False)
    done = F.when(F.coalesce(useful, F.lit(False)), "ok").when(second, "ocr").otherwise("rejected")
    return F.when(status == "success", done).when(status == "partial_success", "partial").when(status.isin("skipped", "failure"), "error").otherwise("unknown")


def join_warnings(warnings: Column, most: int = 1024) -> Column:
    """Each cut to bytes, then joined; a cut character is dropped."""
    cut = lambda w: F.regexp_replace(F.make_valid_utf8(truncate_bytes(w, most).cast("string")), "�+$", "")
    return F.array_join(F.transform(warnings, cut), "; ")


def document_ledger(documents: DataFrame) -> DataFrame:
    """``(paper_id, content, parser, version, status, duration_ms, warnings, error, markdown)`` -> ledger rows."""
    return documents.select("paper_id", F.sha2("content", 256).alias("pdf_hash"), F.col("parser").alias("parser_provider"), F.col("version").alias("parser_version"), "status", F.greatest("duration_ms", F.lit(0)).alias("duration_ms"), F.to_json("warnings").alias("warnings"), F.col("error").alias("error_message"), "markdown")
