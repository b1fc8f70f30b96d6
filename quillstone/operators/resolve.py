"""Discovery planning and entity resolution of bibliographic records.

Records are ``(topic_id, ordinal, id, title, abstract, source, external_id, url, pdf_url, year, venue, doi, arxiv_id,
authors array<struct<name, author_id>>)``; ``ordinal`` is the order in which the sources returned them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity_keys, normalize_arxiv_id, normalize_doi, normalize_title, title_year_key
from ..scratch import written
from .graph import stars

FILLED = ["id", "title", "abstract", "url", "pdf_url", "external_id", "year", "venue", "doi", "arxiv_id"]
RECORD = "topic_id string, ordinal long, id string, title string, abstract string, source string, external_id string, url string, pdf_url string, year int, venue string, doi string, arxiv_id string, authors array<struct<name:string,author_id:string>>"


def allocate_quota(queries: DataFrame, max_papers: int) -> DataFrame:
    """``(topic_id, position, query)`` -> the first queries with their share, once per source."""
    w = Window.partitionBy("topic_id")
    own = queries.withColumn("k", F.row_number().over(w.orderBy("position")) - 1).filter(F.col("k") < max_papers)
    own = own.withColumn("n", F.count("*").over(w))
    quota = F.floor(F.lit(max_papers) / F.col("n")).cast("int") + (F.col("k") < max_papers % F.col("n")).cast("int")
    return own.select("topic_id", "query", quota.alias("quota"), F.explode(F.array(F.lit("semantic_scholar"), F.lit("arxiv"))).alias("source"))


def relaxed(queries: Column, keywords: Column, topic: Column, level: str) -> tuple[Column, Column]:
    """Queries and keywords of the ``full``, ``broad`` or ``minimal`` level."""
    none = F.array().cast("array<string>")
    half = lambda c, least: F.slice(c, F.lit(1), F.greatest(F.lit(least), F.floor(F.size(c) / 2).cast("int")))
    if level == "full":
        return queries, keywords
    if level == "broad":
        return F.when(F.size(queries) <= 1, F.array(topic)).otherwise(half(queries, 2)), F.when(F.size(keywords) <= 2, none).otherwise(half(keywords, 1))
    return F.array(topic), none


def pick_level(found: DataFrame, min_papers: int) -> DataFrame:
    """``(topic_id, level, papers, ok)`` -> each topic's level: the first with enough papers and no error, else the last
    one if it has any, else null."""
    good = F.min(F.when((F.col("papers") >= min_papers) & F.col("ok"), F.col("level")))
    last = F.max_by(F.when(F.col("papers") > 0, F.col("level")), F.col("level"))
    return found.groupBy("topic_id").agg(F.coalesce(good, last).alias("level"))


def shared_author(a: Column, b: Column) -> Column:
    """C5."""
    names = lambda c: F.filter(F.transform(c, lambda x: normalize_title(x["name"])), lambda n: n != "")
    return F.coalesce(F.arrays_overlap(names(a), names(b)), F.lit(False))


#: Groups of records with one identity up to this size are folded in order by one task; larger ones are merged by Spark.
FOLD_ROWS = 10_000


def _identities(records: DataFrame) -> DataFrame:
    """Each record's node and the values that its identities are made of."""
    names = F.array_distinct(F.filter(F.transform(F.coalesce("authors", F.array().cast("array<struct<name:string,author_id:string>>")), lambda x: normalize_title(x["name"])), lambda n: n != ""))
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return records.select("topic_id", "ordinal", F.xxhash64(F.lit("record"), "topic_id", "ordinal").alias("node"), normalize_doi(F.col("doi")).alias("d"), normalize_arxiv_id(F.col("arxiv_id")).alias("a"), lower("source").alias("s"), lower("external_id").alias("e"), normalize_title(F.col("title")).alias("t"), F.coalesce("year", F.lit(0)).alias("y"), names.alias("names"))


def _key(kind: str, *parts: str) -> Column:
    return F.xxhash64(F.lit(kind), "topic_id", *parts)


def _derived(labels: DataFrame) -> DataFrame:
    """``(component, key)``: all (title, year, author) that a paper merged from some of a component's records can have, and the
    (source, external id) where one lacks the latter."""
    titles = labels.filter("t != ''").select("topic_id", "component", "t").distinct()
    years = labels.filter("y > 0").select("component", "y").distinct()
    names = labels.select("component", F.explode("names").alias("n")).distinct()
    works = titles.join(years.hint("merge"), "component").join(names.hint("merge"), "component").select("component", _key("work", "t", "y", "n").alias("key"))
    bare = labels.filter("e = ''").select("component").distinct()
    source = labels.join(bare.hint("merge"), "component", "left_semi")
    ids = source.select("topic_id", "component", "s").distinct().join(source.filter("e != ''").select("component", "e").distinct().hint("merge"), "component")
    return works.unionByName(ids.select("component", _key("source", "s", "e").alias("key"))).distinct()


def _labelled(records: DataFrame) -> DataFrame:
    """The identities of every record with its ``component``; see components()."""
    own = written(_identities(records), "identities")
    strong = F.filter(F.array(F.when(F.col("d") != "", _key("doi", "d")), F.when(F.col("a") != "", _key("arxiv", "a")), F.when(F.col("e") != "", _key("source", "s", "e"))), lambda x: x.isNotNull())
    works = F.when((F.col("t") != "") & (F.col("y") > 0), F.transform("names", lambda n: F.xxhash64(F.lit("work"), "topic_id", "t", "y", n))).otherwise(F.array().cast("array<bigint>"))
    keyed = own.select("node", F.explode(F.concat(strong, works)).alias("key"))
    held = keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key", "lo")
    edges = keyed.join(held.hint("merge"), "key").filter("node != lo").select(F.col("node").alias("a"), F.col("lo").alias("b"))
    star = stars(edges)
    labels = own.join(star.select(F.col("a").alias("node"), "b").hint("merge"), "node", "left").withColumn("component", F.coalesce("b", "node")).drop("b")
    while True:
        labels = written(labels, "labels")
        keys = written(_derived(labels), "derived-keys")
        shared = keys.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi")
        links = written(keys.join(shared.hint("merge"), "key").select(F.col("component").alias("a"), F.col("lo").alias("b")).filter("a != b").distinct(), "bridges")
        if not links.limit(1).count():
            return labels
        star = stars(links, stored=True).select(F.col("a").alias("component"), "b")
        labels = labels.join(star.hint("merge"), "component", "left").withColumn("component", F.coalesce("b", "component")).drop("b")


def components(records: DataFrame) -> DataFrame:
    """``(topic_id, ordinal, component)``: records that the loop can ever bring together, directly or through others.

    First by what records themselves share: DOI, arXiv id, (source, external id), or (title, year, author). A paper merged
    from several records may also have the title of one, the year of another and the author of a third, so components are
    then joined by all such combinations until no two share one. A key links its records to the smallest of them, so a common
    key costs one link per record and a key of one record none; a title alone links nothing.
    """
    return _labelled(records).select("topic_id", "ordinal", "component")


def _title(text: str | None) -> str:
    return " ".join("".join(ch if ch.isalpha() or ch.isnumeric() else " " for ch in (text or "").lower()).split())


def _doi(text: str | None) -> str:
    out = (text or "").lower().strip()
    for prefix in ("https://doi.org/", "http://doi.org/", "doi:"):
        out = out.removeprefix(prefix)
    return out.strip().strip(" .;,)")


def _arxiv(text: str | None) -> str:
    out = (text or "").lower().strip().rpartition("/")[2].removeprefix("arxiv:")
    return re.sub(r"(?<=.)v[0-9]+$", "", out).strip()


def merge_pair(first: dict, second: dict) -> dict:
    """Empty fields of the first are filled; authors are united by name, and their missing ids filled."""
    out = first | {f: second[f] for f in FILLED if not first[f]}
    authors = [dict(a) for a in first["authors"]] or [dict(a) for a in second["authors"]]
    if first["authors"]:
        place = {n: a for a in authors if (n := _title(a["name"]))}
        for other in second["authors"]:
            name = _title(other["name"])
            if name in place:
                place[name]["author_id"] = place[name]["author_id"] or other["author_id"]
            elif name:
                place[name] = dict(other)
                authors.append(place[name])
    return out | {"authors": authors}


def reconcile_in_order(records: list[dict]) -> list[dict]:
    """The order-dependent resolution of one component."""
    papers: list[dict] = []
    by_key: dict[str, int] = {}
    by_title: dict[str, list[int]] = {}

    def keys(r: dict) -> list[str]:
        both = [f"{k}:{v}" for k, v in (("doi", _doi(r["doi"])), ("arxiv", _arxiv(r["arxiv_id"]))) if v]
        own = (r["external_id"] or "").strip().lower()
        return both or ([f"source:{(r['source'] or '').strip().lower()}:{own}"] if own else [])

    def title(r: dict) -> str:
        t = _title(r["title"])
        return f"{t}:{r['year']}" if t and (r["year"] or 0) > 0 else ""

    names = lambda r: {_title(a["name"]) for a in r["authors"]} - {""}
    for r in records:
        at = next((by_key[k] for k in keys(r) if k in by_key), None)
        if at is None:
            at = next((i for i in by_title.get(title(r), []) if papers[i]["source"] != r["source"] and names(papers[i]) & names(r)), None)
        if at is None:
            at = len(papers)
            papers.append(r)
        else:
            papers[at] = merge_pair(papers[at], r)
        for k in keys(papers[at]):
            by_key[k] = at
        if (t := title(papers[at])) and at not in by_title.setdefault(t, []):
            by_title[t].append(at)
    return papers


def merge_in_order(records: DataFrame) -> DataFrame:
    """C6 for whole components that are one paper: every field is the first that is not empty, authors are those of the first
    record that has any, with ids and further names from the later ones. By grouped aggregates, so of any size."""
    some = lambda c: F.when(~F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.col("ordinal"))
    first = lambda c: F.when(F.count(some(c)) > 0, F.min_by(c, some(c))).otherwise(F.max_by(c, "ordinal")).alias(c)
    merged = records.groupBy("topic_id", "component").agg(F.min("ordinal").alias("ordinal"), F.min_by("source", "ordinal").alias("source"), *[first(c) for c in FILLED])
    listed = records.filter(F.size("authors") > 0)
    base = listed.groupBy("component").agg(F.min("ordinal").alias("base"))
    entries = listed.select("component", "ordinal", F.posexplode("authors").alias("pos", "x")).join(base.hint("merge"), "component")
    entries = entries.select("component", F.struct("ordinal", "pos").alias("at"), (F.col("ordinal") == F.col("base")).alias("own"), "x.name", "x.author_id", normalize_title(F.col("x.name")).alias("key"))
    later = F.when(~F.col("own") & (F.coalesce("author_id", F.lit("")) != ""), F.col("at"))
    named = entries.filter("key != ''").groupBy("component", "key").agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"), F.min_by("author_id", "at").alias("author_id"), F.min_by("author_id", later).alias("later"), F.max(F.when(F.col("own"), F.col("at"))).alias("last_own"))
    filled = lambda: F.when(F.coalesce("author_id", F.lit("")) == "", F.coalesce("later", "author_id")).otherwise(F.col("author_id"))
    places = named.select("component", F.col("last_own").alias("at"), "later").filter("at IS NOT NULL")
    kept = entries.filter("own").select("component", "at", "name", "author_id").join(places.hint("merge"), ["component", "at"], "left").select("component", "at", "name", filled().alias("author_id"))
    added = named.filter("last_own IS NULL").select("component", "at", "name", filled().alias("author_id"))
    lists = kept.unionByName(added).groupBy("component").agg(F.array_sort(F.collect_list(F.struct("at", "name", "author_id"))).alias("x"))
    authors = lists.select("component", F.transform("x", lambda x: F.struct(x["name"].alias("name"), x["author_id"].alias("author_id"))).alias("authors"))
    none = F.array().cast("array<struct<name:string,author_id:string>>")
    return merged.join(authors.hint("merge"), "component", "left").withColumns({"authors": F.coalesce("authors", none), "year": F.coalesce("year", F.lit(0))})


def reconcile(records: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """C4: one row per paper, in the order in which each was first seen (``ordinal``).

    Components are found by joins on true identities. Those of one record pass through untouched. A component of more than
    ``fold_rows`` records that all have the same first identity is one paper whatever the order, and is merged by
    aggregates; the others are folded in order: they come sorted by component and ordinal, so a task holds one at a time.
    """
    labels = _labelled(records)
    identity = F.when(F.col("d") != "", F.concat(F.lit("d:"), "d")).when(F.col("a") != "", F.concat(F.lit("a:"), "a")).when(F.col("e") != "", F.concat(F.lit("s:"), "s", F.lit(":"), "e"))
    n = labels.select("component", identity.alias("_i")).groupBy("component").agg(F.count("*").alias("_n"), (F.count("_i") == F.count("*")).alias("_all"), (F.min("_i") == F.max("_i")).alias("_same"))
    sized = n.select("component", "_n", (F.coalesce(F.col("_all") & F.col("_same"), F.lit(False)) & (F.col("_n") > fold_rows)).alias("_one"))
    place = written(labels.select("topic_id", "ordinal", "component").join(sized.hint("merge"), "component"), "places")
    alone = records.join(place.filter("_n = 1").select("topic_id", "ordinal").hint("merge"), ["topic_id", "ordinal"], "left_semi")
    grouped = written(records.join(place.filter("_n > 1").select("topic_id", "ordinal", "component", "_one").hint("merge"), ["topic_id", "ordinal"]), "grouped-records")
    merged = merge_in_order(grouped.filter("_one")).select(*records.columns)

    columns = records.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, rows, done, schema = None, [], [], None
        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(c) for c in columns])
            for r in batch.to_pylist():
                own = r.pop("component")
                if own != component:
                    done += reconcile_in_order(rows)
                    component, rows = own, []
                rows.append(r | {"authors": r["authors"] or [], "year": r["year"] or 0})
            if len(done) >= 1000:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        done += reconcile_in_order(rows)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)

    many = grouped.filter("NOT _one").drop("_one").repartition("component").sortWithinPartitions("component", "ordinal").mapInArrow(fold, records.schema)
    return alone.select(*records.columns).unionByName(many).unionByName(merged)


def reconcile_closure(records: DataFrame) -> DataFrame:
    """C4 without order: components over true identity keys and title-year-author keys, each merged by first values.

    Differs from reconcile() only where a late record bridges two papers: here they become one.
    """
    strong = identity_keys(F.col("doi"), F.col("arxiv_id"), F.col("source"), F.col("external_id"))
    t = title_year_key(F.col("title"), F.col("year"))
    names = F.filter(F.transform("authors", lambda a: normalize_title(a["name"])), lambda x: x != "")
    weak = F.when(t != "", F.transform(names, lambda x: F.concat(t, F.lit("|"), x))).otherwise(F.array().cast("array<string>"))
    node = F.xxhash64(F.lit("record"), "topic_id", "ordinal")
    own = records.withColumn("a", node)
    edges = own.select("a", "topic_id", F.explode(F.concat(strong, weak)).alias("key")).select("a", F.xxhash64(F.lit("key"), "topic_id", "key").alias("b"))
    joined = own.join(stars(edges).hint("merge"), "a", "left").withColumn("component", F.coalesce("b", "a")).drop("a", "b")
    first = lambda c: F.min_by(F.col(c), F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(None)).otherwise(F.col("ordinal"))).alias(c)
    return joined.groupBy("topic_id", "component").agg(F.min("ordinal").alias("ordinal"), F.count("*").alias("members"), F.min_by("source", "ordinal").alias("source"), *[first(c) for c in FILLED]).drop("component")


def merged_authors(records: DataFrame) -> DataFrame:
    """C6 for a key ``(topic_id, paper)``: authors united by name in order, each with the first id it has."""
    rows = records.select("topic_id", "paper", "ordinal", F.posexplode("authors").alias("pos", "a"))
    rows = rows.withColumn("key", normalize_title(F.col("a.name"))).filter("key != ''")
    at = F.struct("ordinal", "pos")
    one = rows.groupBy("topic_id", "paper", "key").agg(F.min(at).alias("at"), F.min_by("a.name", at).alias("name"), F.min_by("a.author_id", F.when(F.coalesce("a.author_id", F.lit("")) != "", at)).alias("author_id"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "name", "author_id"))), lambda x: F.struct(x["name"].alias("name"), x["author_id"].alias("author_id")))
    return one.groupBy("topic_id", "paper").agg(ordered.alias("authors"))


def cap_papers(papers: DataFrame, most: int) -> DataFrame:
    """C7."""
    n = F.row_number().over(Window.partitionBy("topic_id").orderBy("ordinal"))
    return papers.withColumn("_n", n).filter(F.col("_n") <= most).drop("_n")


def search_outcome(searches: DataFrame) -> DataFrame:
    """A topic fails only if all its searches did; the causes are joined."""
    cause = F.array_join(F.array_sort(F.collect_set(F.when(~F.col("ok"), F.col("error")))), "; ")
    return searches.groupBy("topic_id").agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("total"), F.when(F.count_if("ok") == 0, cause).alias("error"))


def batch_outcome(items: DataFrame, operation: str) -> DataFrame:
    """The outcome of each batch of items (kind, id, ok, cause); the message, null where nothing failed, names every failure."""
    out = items.groupBy("batch").agg(F.count("*").alias("total"), F.count_if("ok").alias("succeeded"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.struct("id", "kind", "cause")))).alias("failures"))
    causes = F.array_join(F.transform("failures", lambda x: F.concat(x["kind"], F.lit(" "), x["id"].cast("string"), F.lit(": "), F.coalesce(x["cause"], F.lit("")))), "; ")
    text = F.concat(F.format_string(f"{operation} completed with %d/%d successful: ", "succeeded", "total"), causes)
    return out.withColumn("message", F.when(F.size("failures") > 0, text))


def min_papers_gate(topics: DataFrame, papers: DataFrame, least: int) -> DataFrame:
    """Topics with too few papers and what to tell them."""
    n = papers.groupBy("topic_id").agg(F.count("*").alias("papers"))
    j = topics.join(n, "topic_id", "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    return j.filter(F.col("papers") < least).select("topic_id", "papers", F.format_string(f"found %d papers, need {least}", "papers").alias("message"))


#: Rows to a task where all citations are shuffled, about.
TASK_ROWS = 1_000_000


def spread(rows: DataFrame) -> int:
    """How many partitions give a task about ``TASK_ROWS`` of ``rows``; no fewer than the session's. ``rows`` should be cheap to count."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // TASK_ROWS + 1)


def _dealt(rows: DataFrame, parts: int | None, key: str) -> DataFrame:
    return rows.repartition(parts, key) if parts else rows.repartition(key)


def citation_edges(hits: DataFrame, parts: int | None = None) -> DataFrame:
    """C11: distinct ``(citing, cited)`` from the references of search hits (read_search_json); a paper does not cite itself and
    blank ids are none. ``parts``: see citation_degrees()."""
    edges = hits.select(F.col("hit.paperId").alias("citing"), F.explode(F.transform("hit.references", lambda r: r["paperId"])).alias("cited"))
    edges = edges.filter("trim(coalesce(citing, '')) != '' AND trim(coalesce(cited, '')) != '' AND citing != cited")
    return _dealt(edges, parts, "citing").distinct()


def citation_degrees(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """C11: ``(citing, cited)`` edges, repeated or not -> out- and in-degree.

    Edges are dealt by the citing paper to ``parts`` partitions (``spread`` of the table that they come from), so the memory of a task
    does not grow with them; out-degrees need no further shuffle and in-degrees are added up before theirs.
    """
    e = _dealt(edges.select("citing", "cited"), parts, "citing").distinct()
    out = e.groupBy(F.col("citing").alias("id")).agg(F.count("*").alias("o")).withColumn("i", F.lit(0).cast("long"))
    cited = e.groupBy(F.col("cited").alias("id")).agg(F.count("*").alias("i")).select("id", F.lit(0).cast("long").alias("o"), "i")
    return _dealt(out.unionByName(cited), parts, "id").groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
