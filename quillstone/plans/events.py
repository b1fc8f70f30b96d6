"""Queries of sources and sinks (A) and of job and stage state (J)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import TableStore
from ..scratch import scratch_path
from ..sources import records as S
from ..sources import sinks
from ..streaming import processors as P
from ..streaming import state as J
from .views import JOB_EVENTS, PAPERS, TOPIC_PAPERS, job_events, papers, table, topic_papers


def _search_payloads(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    authors = F.array(F.struct(F.col("external_id").alias("authorId"), F.concat(F.lit("Author "), (F.col("paper_id") % 7).cast("string")).alias("name")))
    hit = F.struct(F.col("external_id").alias("paperId"), "title", "abstract", F.lit("http://u").alias("url"), "year", "venue", F.when(F.col("paper_id") % 2 == 0, F.struct(F.concat(F.lit("http://x/"), F.col("external_id")).alias("url"))).alias("openAccessPdf"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), authors.alias("authors"))
    page = p.groupBy(F.floor(F.col("paper_id") / 20).alias("page")).agg(F.array_sort(F.collect_list(F.struct("paper_id", hit.alias("hit")))).alias("h"))
    return page.select("page", F.to_json(F.struct(F.size("h").alias("total"), F.lit(0).alias("offset"), F.transform("h", lambda x: x["hit"]).alias("data"))).alias("payload"))


def search_json(spark: SparkSession, sf: str) -> DataFrame:
    hits = S.read_search_json(_search_payloads(spark, sf), ["page"])
    return hits.select("page", "position", "hit.paperId", F.sha2("hit.title", 256).alias("title"), F.size("hit.authors").alias("authors"))


def unified_records(spark: SparkSession, sf: str) -> DataFrame:
    out = S.unify_search(S.read_search_json(_search_payloads(spark, sf), ["page"]), ["page"])
    return out.select("external_id", "source", "year", "venue", "doi", "pdf_url", F.sha2("abstract", 256).alias("abstract"), F.element_at("authors", 1)["name"].alias("author"))


def _feeds(spark: SparkSession, sf: str) -> DataFrame:
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    p = papers(spark, sf)
    url = F.concat(F.lit("http://arxiv.org/abs/"), F.col("external_id"))
    entry = F.concat(F.lit("<entry><id>"), url, F.lit("</id><title> "), esc(F.col("title")), F.lit(" </title><summary>"), F.lit("s\nt"), F.lit("</summary><published>"), F.col("year").cast("string"), F.lit("-05-01T00:00:00Z</published><author><name>A</name></author><author><name>B</name></author><arxiv:doi>"), F.col("doi"), F.lit('</arxiv:doi><link href="'), url, F.lit('" rel="alternate" type="text/html"/><link title="pdf" href="http://p/'), F.col("external_id"), F.lit('" rel="related" type="application/pdf"/><category term="cs.DL"/></entry>'))
    rows = p.groupBy(F.floor(F.col("paper_id") / 20).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paper_id", entry.alias("e")))), lambda x: x["e"]), "").alias("b"))
    return rows.select("page", F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">'), F.col("b"), F.lit("</feed>")).alias("payload"))


def atom_xml(spark: SparkSession, sf: str) -> DataFrame:
    out = S.unify_atom(S.read_atom_xml(_feeds(spark, sf), ["page"]), ["page"])
    return out.select("external_id", "year", "doi", "url", "pdf_url", "abstract", F.size("authors").alias("authors"))


def id_lookup(spark: SparkSession, sf: str) -> DataFrame:
    rows = papers(spark, sf).filter("paper_id % 3 = 0").select(F.col("external_id").alias("id"), "title")
    return S.lookup_by_ids(rows, papers(spark, sf).filter("paper_id % 2 = 0").select(F.col("external_id").alias("id")))


def search_expr(spark: SparkSession, sf: str) -> DataFrame:
    p = papers(spark, sf)
    return p.select("paper_id", S.build_search_expr(F.col("topic_id"), F.array(F.lit(" a "), F.lit("  "), F.col("external_id"))).alias("expr"))


def binary_checks(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    k = F.col("page_id")
    fault = S.binary_fault(F.encode("html", "utf-8"), F.when(k % 5 == 0, "text/html").when(k % 2 == 0, "application/pdf; charset=x"), F.when(k % 7 == 0, 10**9).otherwise(F.length("html")), most=9000, signature="<!DOCTYPE")
    return p.select("page_id", fault.alias("fault"))


def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", S.useful_chars(F.col("text")).alias("n"), (S.useful_chars(F.col("text")) >= 200).alias("usable"))


def conversion_class(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    d = table(spark, sf, "documents")
    status = F.when(k % 11 == 0, "failure").when(k % 13 == 0, "partial_success").otherwise("success")
    return d.select("doc_id", S.classify_conversion(status, S.useful_chars(F.col("text")) >= 500, k % 3 == 0).alias("class"), F.length(S.join_warnings(F.array(F.lit("w"), F.col("text")))).alias("warned"))


def document_ledger(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select(F.col("page_id").alias("paper_id"), F.encode("html", "utf-8").alias("content"), F.lit("docling").alias("parser"), F.lit("1").alias("version"), F.lit("completed").alias("status"), (F.col("page_id") - 5).alias("duration_ms"), F.array(F.lit("a"), F.lit("b")).alias("warnings"), F.lit(None).cast("string").alias("error"), F.lit("m").alias("markdown"))
    return S.document_ledger(p)


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    t = topic_papers(spark, sf).groupBy("topic_id").agg(F.array_sort(F.collect_list("paper_id")).alias("papers"), F.count("*").alias("n"))
    return t.select("topic_id", F.when(F.col("topic_id") == "src7", "processing").otherwise("completed").alias("status"), "papers", F.when(F.col("n") < 0, F.array(F.lit("g"))).alias("gaps"), F.concat(F.lit("# Report "), "topic_id").alias("markdown"))


def result_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.result_json(_reports(spark, sf).select("topic_id", "status", "papers", "gaps"))


def _topics(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id")
    status = F.when(k % 5 == 0, "failed").when(k % 3 == 0, "processing").otherwise("completed")
    return table(spark, sf, "documents").select(k.cast("string").alias("topic_id"), F.concat(F.lit("r"), k.cast("string")).alias("run_id"), status.alias("status"), F.lit("ranking").alias("current_stage"), F.lit(0.25).alias("progress"), F.when(k % 5 == 0, 'a "bad" page').when(k % 2 == 0, "").alias("error_message"))


def status_json(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.status_json(_topics(spark, sf))


def refused_artefacts(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.refused(_topics(spark, sf))


def bibliography_artefacts(spark: SparkSession, sf: str) -> DataFrame:
    """Bibliographies of the completed topics, written a folder for each and read back."""
    path = scratch_path(spark, "bibliographies")
    entries = F.concat(F.lit("@article{"), F.col("topic_id"), F.lit(",\n}\n"))
    sinks.write_text(_reports(spark, sf).withColumn("bibtex", entries), "bibtex", path)
    return spark.read.text(path, lineSep="\n\f\n").select("topic_id", F.col("value").alias("bibtex"))


def artefacts(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "artefacts")
    sinks.write_text(_reports(spark, sf), "markdown", path)
    return spark.read.text(path, lineSep="\n\f\n").select("topic_id", F.col("value").alias("markdown"))


def stage_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.when(F.col("event_id") % 5 == 0, "failed").when(F.col("event_id") % 2 == 0, "started").otherwise("completed")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"), kind.alias("kind"), "ts", "event_id")


_STAGE = "s AS (SELECT user_id AS run_id, event_type AS stage, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'started' ELSE 'completed' END AS kind, ts, event_id FROM events)"


#: Events a file of a followed folder holds, about.
FILE_EVENTS = 250_000


def _followed(spark: SparkSession, events: DataFrame, key: str, processor: P.StatefulProcessor, rows: str, file_events: int = FILE_EVENTS) -> str:
    """The events as a file stream in four micro-batches by time, every tenth event twice; the folder of what was written.

    All quarters have the same number of files, so that a micro-batch is a quarter: each file gets an event of its quarter
    once more (of an earlier one, if the quarter is empty), so none is left out for having no rows.
    """
    src, out, checkpoint = (scratch_path(spark, t) for t in ("events", "state", "offsets"))
    first, last, n = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    files = max(1, -(-n // (4 * file_events)))
    part = F.least(F.floor((F.unix_micros("ts") - F.unix_micros(F.lit(first))) * 4 / (F.unix_micros(F.lit(last)) - F.unix_micros(F.lit(first)) + 1)), F.lit(3))
    anchor = None
    for k in range(4):
        own = events.filter(part == k)
        twice = own.unionByName(own.filter("event_id % 10 = 0"))
        if files == 1:
            twice = twice.coalesce(1)
        else:
            anchor = own.limit(1).collect() or anchor
            place = F.pmod(F.xxhash64("event_id"), F.lit(files)).cast("int")
            more = spark.createDataFrame(anchor, events.schema).withColumn("_file", F.explode(F.array(*[F.lit(i) for i in range(files)])))
            twice = twice.withColumn("_file", place).unionByName(more).repartitionById(files, "_file").drop("_file")
        twice.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(src)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    J.follow(spark, src, schema, key, processor, rows, out, checkpoint, files=files).awaitTermination()
    return out


def _jobs(spark: SparkSession, sf: str) -> str:
    e = job_events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "job_id", "kind", F.col("props").alias("error"))
    clear = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.to_timestamp(F.lit(_CLEARED)).alias("ts"), F.lit(-1).cast("long").alias("job_id"), F.lit("cleared").alias("kind"), F.lit(None).cast("string").alias("error"))
    return _followed(spark, e.unionByName(clear), "job_id", P.JobProcessor(), P.JOB_ROWS)


def job_state(spark: SparkSession, sf: str) -> DataFrame:
    """J1 as a stream: the state after the last batch."""
    rows = J.written_rows(spark, _jobs(spark, sf), P.JOB_ROWS, "state")
    return J.current_rows(rows, "job_id").select("job_id", "attempts", "failures", "retries", "state")


def dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    """J1 as a stream: the failures that killed jobs."""
    dead = J.written_rows(spark, _jobs(spark, sf), P.JOB_ROWS, "dead")
    return dead.select("job_id", "event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "error")


def dead_letters_batch(spark: SparkSession, sf: str) -> DataFrame:
    return J.dead_letters(job_events(spark, sf).withColumn("error", F.col("props"))).select("job_id", "event_id", "ts", "error")


def stuck_stream(spark: SparkSession, sf: str) -> DataFrame:
    """J2 as a stream: every delivery after which its job was silent for 11 minutes."""
    return J.written_rows(spark, _jobs(spark, sf), P.JOB_ROWS, "stuck").select("job_id", "event_id")


def queue_depth_stream(spark: SparkSession, sf: str) -> DataFrame:
    return J.depth_after(spark, _jobs(spark, sf), P.JOB_ROWS)


def latest_status_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("job_id").alias("key"), "kind")
    out = _followed(spark, e, "key", P.StatusProcessor(), P.STATUS_ROWS)
    return J.current_statuses(spark, out, P.STATUS_ROWS).select(F.col("key").alias("job_id"), "kind", "event_id")


def _runs(spark: SparkSession, sf: str) -> str:
    stage = F.element_at(F.array(*[F.lit(n) for n, _ in J.STAGES]), (F.col("event_id") % 7 + 1).cast("int"))
    e = stage_events(spark, sf).select("event_id", F.col("ts").cast("timestamp").alias("ts"), "run_id", stage.alias("stage"), "kind", F.concat(F.lit("fault "), F.col("event_id").cast("string")).alias("error"))
    return _followed(spark, e, "run_id", P.RunProcessor(dict(J.STAGES)), P.RUN_ROWS)


def stage_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = J.written_rows(spark, _runs(spark, sf), P.RUN_ROWS, "stage")
    return J.current_rows(rows, "run_id", "stage").select("run_id", "stage", "status", "attempt", "failures", "error")


def topic_stream(spark: SparkSession, sf: str) -> DataFrame:
    rows = J.written_rows(spark, _runs(spark, sf), P.RUN_ROWS, "topic")
    return J.current_rows(rows, "run_id").select("run_id", "stage", "status", "progress", "error")


_CLEARED = "2024-01-15 00:00:00"
_NOW = "2024-01-30 00:00:00"


def stuck_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return J.stuck_jobs(job_events(spark, sf), F.to_timestamp(F.lit(_NOW)), 660_000).select("job_id")


def stage_state(spark: SparkSession, sf: str) -> DataFrame:
    return J.stage_state(stage_events(spark, sf))


def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    return J.queue_depth(job_events(spark, sf))


def latest_status(spark: SparkSession, sf: str) -> DataFrame:
    return J.latest_status(job_events(spark, sf), "job_id", F.to_timestamp(F.lit(_NOW))).select("job_id", "kind", "event_id")


def status_stream(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf)
    now = J.job_state(e.filter("event_id < 5000")).select("job_id", F.col("last").alias("kind"))
    return J.status_stream(now, e.filter("event_id >= 5000"), "job_id")


def pipeline_run(spark: SparkSession, sf: str) -> DataFrame:
    names = [s for s, _ in J.STAGES]
    stage = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 7 + 1).cast("int"))
    marks = table(spark, sf, "events").filter("event_id % 23 < 9").select((F.col("user_id") * 10 + F.col("event_id") % 10).alias("run_id"), stage.alias("stage"), F.when(F.col("event_id") % 29 == 0, "failed").otherwise("completed").alias("status"))
    return J.run_progress(marks)


def stage_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Two stages through the table store, run twice under one run id: the second run repeats nothing."""
    store = TableStore(spark, scratch_path(spark, "run"))
    stages = [("kept", lambda t: t["papers"].filter("year > 2005")), ("counted", lambda t: t["kept"].groupBy("year").agg(F.count("*").alias("n")))]
    tables = {"papers": papers(spark, sf)}
    first = J.run_pipeline(stages, tables, store, "r1")
    again = J.run_pipeline(stages, tables, store, "r1")
    return tables["counted"].withColumns({"ran": F.lit(len(first)), "again": F.lit(len(again))})


def replay(spark: SparkSession, sf: str) -> DataFrame:
    e = job_events(spark, sf)
    return J.job_state(J.distinct_events(e.unionByName(e))).select("job_id", "attempts", "failures", "state")


_JOB = """p AS (SELECT job_id, count(*) FILTER (WHERE kind = 'failed') AS failures, count(*) FILTER (WHERE kind = 'delivered') AS attempts, arg_max(kind, (ts, event_id)) AS last, max(ts) AS last_seen FROM job_events GROUP BY 1),
j AS (SELECT *, least(failures, 3) AS retries, CASE WHEN failures >= 3 THEN 'dead' WHEN last = 'completed' THEN 'done' WHEN last = 'delivered' THEN 'processing' ELSE 'queued' END AS state FROM p)"""
_STAGES = "s AS (SELECT event_id, ts, user_id AS run_id, event_id % 7 AS i, [" + ", ".join(f"'{n}'" for n, _ in J.STAGES) + "][event_id % 7 + 1] AS stage, CASE WHEN event_id % 5 = 0 THEN 'failed' WHEN event_id % 2 = 0 THEN 'started' ELSE 'completed' END AS kind FROM events)"
_MARK = "w AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events)"
_DEAD = "dead AS (SELECT job_id, event_id, ts, props AS error FROM job_events WHERE kind = 'failed' QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) = 3)"
_RUN = ", ".join(f"'{s}'" for s, _ in J.STAGES)
_USE = "length(translate(text, ' ' || chr(9) || chr(13) || chr(10) || '#*_`-', ''))"
QUERIES = {
    "search_json": (search_json, f"WITH {PAPERS} SELECT paper_id // 20 AS page, (row_number() OVER (PARTITION BY paper_id // 20 ORDER BY paper_id) - 1)::INT AS position, external_id AS \"paperId\", sha256(title) AS title, 1 AS authors FROM papers"),
    "unified_records": (unified_records, f"WITH {PAPERS} SELECT external_id, 'semantic_scholar' AS source, year, coalesce(venue, '') AS venue, doi, CASE WHEN paper_id % 2 = 0 THEN 'http://x/' || external_id ELSE '' END AS pdf_url, sha256(abstract) AS abstract, 'Author ' || paper_id % 7 AS author FROM papers"),
    "atom_xml": (atom_xml, f"WITH {PAPERS} SELECT external_id, year, doi, 'http://arxiv.org/abs/' || external_id AS url, 'http://p/' || external_id AS pdf_url, 's t' AS abstract, 2 AS authors FROM papers"),
    "id_lookup": (id_lookup, f"WITH {PAPERS} SELECT external_id AS id, CASE WHEN paper_id % 3 = 0 THEN title END AS title, CASE WHEN paper_id % 3 <> 0 THEN 'no record for ' || external_id END AS error FROM papers WHERE paper_id % 2 = 0"),
    "search_expr": (search_expr, f"WITH {PAPERS} SELECT paper_id, 'all:' || topic_id || ' AND all:a AND all:' || external_id AS expr FROM papers"),
    "binary_checks": (binary_checks, "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'media type' WHEN page_id % 7 = 0 OR length(html) > 9000 AND page_id % 7 <> 0 THEN 'declared size' WHEN octet_length(encode(html)) > 9000 THEN 'size' WHEN NOT contains(html, '<!DOCTYPE') THEN 'signature' END AS fault FROM pages"),
    "quality_gate": (quality_gate, f"SELECT doc_id, {_USE}::INT AS n, {_USE} >= 200 AS usable FROM documents"),
    "conversion_class": (conversion_class, f"SELECT CASE WHEN doc_id % 11 = 0 THEN 'error' WHEN doc_id % 13 = 0 THEN 'partial' WHEN {_USE} >= 500 THEN 'ok' WHEN doc_id % 3 = 0 THEN 'ocr' ELSE 'rejected' END AS class, doc_id, CASE WHEN text IS NULL THEN 1 ELSE 3 + list_max(list_filter(range(0, length(left(text, 1024)) + 1), lambda k: strlen(left(text, k::INT)) <= 1024)) END::INT AS warned FROM documents"),
    "document_ledger": (document_ledger, "SELECT page_id AS paper_id, sha256(html) AS pdf_hash, 'docling' AS parser_provider, '1' AS parser_version, 'completed' AS status, greatest(page_id - 5, 0) AS duration_ms, '[\"a\",\"b\"]' AS warnings, NULL::VARCHAR AS error_message, 'm' AS markdown FROM pages"),
    "result_json": (result_json, f"WITH {TOPIC_PAPERS}, t AS (SELECT topic_id, string_agg(paper_id::VARCHAR, ',' ORDER BY paper_id) AS p FROM topic_papers GROUP BY 1) SELECT topic_id, '{{\"topic_id\":\"' || topic_id || '\",\"status\":\"completed\",\"papers\":[' || p || '],\"gaps\":[]}}' AS document FROM t WHERE topic_id <> 'src7'"),
    "status_json": (status_json, "SELECT doc_id::VARCHAR AS topic_id, '{\"topic_id\":\"' || doc_id || '\",\"run_id\":\"r' || doc_id || '\",\"status\":\"' || CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 3 = 0 THEN 'processing' ELSE 'completed' END || '\",\"stage\":\"ranking\",\"progress\":0.25' || CASE WHEN doc_id % 5 = 0 THEN ',\"error\":\"a \\\"bad\\\" page\"' ELSE '' END || '}' AS document FROM documents"),
    "refused_artefacts": (refused_artefacts, "SELECT doc_id::VARCHAR AS topic_id, 'topic is ' || CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'processing' END AS reason FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0"),
    "bibliography_artefacts": (bibliography_artefacts, "SELECT DISTINCT source AS topic_id, '@article{' || source || ',' || chr(10) || '}' || chr(10) AS bibtex FROM documents WHERE source <> 'src7'"),
    "artefacts": (artefacts, "SELECT DISTINCT source AS topic_id, '# Report ' || source AS markdown FROM documents WHERE source <> 'src7'"),
    "job_state": (job_state, f"WITH {JOB_EVENTS}, {_JOB} SELECT job_id, attempts, failures, retries, state FROM j"),
    "dead_letters": (dead_letters, f"WITH {JOB_EVENTS}, {_DEAD} SELECT * FROM dead"),
    "dead_letters_batch": (dead_letters_batch, f"WITH {JOB_EVENTS}, {_DEAD} SELECT * FROM dead"),
    "stuck_stream": (stuck_stream, f"WITH {JOB_EVENTS}, {_MARK}, n AS (SELECT job_id, event_id, kind, epoch_ms(ts) AS ms, lead(epoch_ms(ts)) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS nxt FROM job_events) SELECT job_id, event_id FROM n, w WHERE kind = 'delivered' AND coalesce(nxt, mark) > ms + 660000"),
    "queue_depth_stream": (queue_depth_stream, f"WITH {JOB_EVENTS}, {_JOB}, {_DEAD} SELECT count(*) FILTER (WHERE state = 'queued') AS ready, count(*) FILTER (WHERE state = 'processing') AS processing, (SELECT count(*) FROM dead WHERE ts > TIMESTAMP '{_CLEARED}') AS dead FROM j"),
    "latest_status_stream": (latest_status_stream, f"WITH {JOB_EVENTS}, {_MARK}, l AS (SELECT job_id, arg_max(kind, (ts, event_id)) AS kind, arg_max(event_id, (ts, event_id)) AS event_id, epoch_ms(max(ts)) AS ms FROM job_events GROUP BY 1) SELECT job_id, kind, event_id FROM l, w WHERE ms + 86400000 > mark"),
    "stage_stream": (stage_stream, f"WITH {_STAGES} SELECT run_id, stage, arg_max(CASE kind WHEN 'started' THEN 'running' ELSE kind END, (ts, event_id)) AS status, count(*) FILTER (WHERE kind IN ('started', 'failed')) AS attempt, count(*) FILTER (WHERE kind = 'failed') AS failures, nullif(arg_max(CASE WHEN kind = 'failed' THEN 'fault ' || event_id ELSE '' END, (ts, event_id)), '') AS error FROM s GROUP BY run_id, stage"),
    "topic_stream": (topic_stream, f"WITH {_STAGES}, l AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY ts DESC, event_id DESC) = 1) SELECT run_id, stage, CASE WHEN kind = 'failed' THEN 'failed' WHEN kind = 'completed' AND i = 6 THEN 'completed' ELSE 'processing' END AS status, CASE WHEN kind = 'completed' AND i = 6 THEN 1.0 ELSE [{', '.join(str(m) for _, m in J.STAGES)}][i + 1] END::DOUBLE AS progress, CASE WHEN kind = 'failed' THEN 'fault ' || event_id END AS error FROM l"),
    "stuck_jobs": (stuck_jobs, f"WITH {JOB_EVENTS}, {_JOB} SELECT job_id FROM j WHERE last = 'delivered' AND last_seen < TIMESTAMP '{_NOW}' - INTERVAL 11 MINUTE"),
    "stage_state": (stage_state, f"WITH {_STAGE} SELECT run_id, stage, count(*) FILTER (WHERE kind IN ('started', 'failed')) AS attempt, arg_max(kind, (ts, event_id)) AS status, count(*) FILTER (WHERE kind = 'failed') AS failures FROM s GROUP BY ALL"),
    "queue_depth": (queue_depth, f"WITH {JOB_EVENTS}, p AS (SELECT job_id, count(*) FILTER (WHERE kind = 'enqueued') AS e, count(*) FILTER (WHERE kind = 'delivered') AS d, count(*) FILTER (WHERE kind = 'completed') AS c, count(*) FILTER (WHERE kind = 'failed') AS f FROM job_events GROUP BY 1) SELECT sum(greatest(e - d, 0))::BIGINT AS ready, sum(greatest(d - c - f, 0))::BIGINT AS processing, count(*) FILTER (WHERE f >= 3) AS dead FROM p"),
    "latest_status": (latest_status, f"WITH {JOB_EVENTS} SELECT job_id, arg_max(kind, (ts, event_id)) AS kind, arg_max(event_id, (ts, event_id)) AS event_id FROM job_events GROUP BY 1 HAVING max(ts) >= TIMESTAMP '{_NOW}' - INTERVAL 24 HOUR"),
    "status_stream": (status_stream, f"WITH {JOB_EVENTS} SELECT job_id, arg_max(kind, (ts, event_id)) AS kind, 0 AS sequence FROM job_events WHERE event_id < 5000 GROUP BY 1 UNION ALL SELECT job_id, kind, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id)::INT FROM job_events WHERE event_id >= 5000"),
    "pipeline_run": (pipeline_run, f"WITH e AS (SELECT user_id * 10 + event_id % 10 AS run_id, (event_id % 7)::INT AS i, event_id % 29 = 0 AS bad FROM events WHERE event_id % 23 < 9), g AS (SELECT DISTINCT run_id FROM e), x AS (SELECT g.run_id, s.i FROM g, (SELECT unnest(range(7))::INT AS i) s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = g.run_id AND e.i = s.i AND NOT bad)), m AS (SELECT run_id, min(i) AS i FROM x GROUP BY 1), b AS (SELECT DISTINCT run_id FROM e WHERE bad) SELECT g.run_id, [{_RUN}][m.i + 1] AS stage, coalesce([{', '.join(str(m) for _, m in J.STAGES)}][m.i + 1], 1.0)::DOUBLE AS progress, CASE WHEN m.i IS NULL THEN 'completed' WHEN b.run_id IS NOT NULL THEN 'failed' ELSE 'processing' END AS status FROM g LEFT JOIN m USING (run_id) LEFT JOIN b USING (run_id)"),
    "stage_tables": (stage_tables, f"WITH {PAPERS} SELECT year, count(*) AS n, 2 AS ran, 0 AS again FROM papers WHERE year > 2005 GROUP BY 1"),
    "replay": (replay, f"WITH {JOB_EVENTS}, {_JOB} SELECT job_id, attempts, failures, state FROM j"),
}
