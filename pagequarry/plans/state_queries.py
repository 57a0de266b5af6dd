"""Queries over ordered changes: logs, users, asked queries, checked writes, and answers of models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.functions import text as tx
from pagequarry.operators import access, lexical, metrics, pages, reading
from pagequarry.plans import inputs as src
from pagequarry.plans.ingest_queries import page_row
from pagequarry.plans.search_queries import containing_documents
from pagequarry.plans.search_queries import query as _query
from pagequarry.session import cut_lineage, shared_folder
from pagequarry.sources.snapshots import ChangeRejected, SnapshotTable
from pagequarry.streaming import seen

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    return _query(oracle, QUERIES, ORACLES)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- the log ------------------------------------------------------------------------------------------

def _flat_logs(spark: SparkSession, sf: str) -> DataFrame:
    """Five flat logs: a title, then a heading and up to three lines per event; the last log has no headings."""
    e = src.table(spark, sf, "events").select("event_id", "event_type", "ts", (F.col("user_id") % 5).alias("u"))
    head = F.concat(F.lit("## "), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(" — "), "event_type")
    more = F.transform(F.sequence(F.lit(0), (F.col("event_id") % 4).cast("int")), lambda k: F.when(k == 0, head).when(
        k == 3, "").otherwise(F.concat(F.lit("  detail  "), F.col("event_id").cast("string"), F.lit("."), k.cast("string"))))
    rows = e.select(F.concat(F.lit("log-"), "u").alias("db"), "event_id", F.posexplode(F.when(F.col("u") < 4, more).otherwise(
        F.array(F.concat(F.lit("note "), "event_id")))).alias("k", "line"))
    titles = e.select("u").distinct().select(F.concat(F.lit("log-"), "u").alias("db"), F.lit(-1).cast("bigint").alias("line_no"), F.lit("# Log").alias("line"))
    return rows.select("db", (F.col("event_id") * 10 + F.col("k")).cast("bigint").alias("line_no"), "line").unionByName(titles)


@query("""WITH e AS (SELECT 'log-' || (user_id % 5) AS db, event_id AS i, event_type AS t, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M') AS hm FROM events),
 h AS (SELECT *, min(i * 10) OVER (PARTITION BY db, day) AS day_at FROM e WHERE db <> 'log-4')
SELECT db, day_at, i * 10 AS entry_at, '- ' || hm || ' — ' || t || CASE i % 4 WHEN 0 THEN '' WHEN 1 THEN ': detail ' || i || '.1' ELSE ': detail ' || i || '.1 detail ' || i || '.2' END AS line FROM h
UNION ALL SELECT DISTINCT db, day_at, 9223372036854775807, '## ' || day FROM h
UNION ALL SELECT db, NULL, i * 10, 'note ' || i FROM e WHERE db = 'log-4' UNION ALL SELECT DISTINCT db, NULL::BIGINT, -1, '# Log' FROM e WHERE db = 'log-4'""")
def rewritten_log(spark: SparkSession, sf: str) -> DataFrame:
    """Flat logs rewritten under day headings."""
    return pages.rewritten_log(_flat_logs(spark, sf))


# --- users --------------------------------------------------------------------------------------------------

_CHANGES = """ev AS (SELECT o_custkey AS u, o_orderkey AS seq, ['add', 'delete', 'set_dbs', 'grant', 'set_maintains', 'grant', 'add', 'grant'][o_orderkey % 8 + 1] AS op,
   CASE WHEN o_orderkey % 8 IN (3, 5, 7) THEN ['d' || (o_orderkey % 7)] ELSE ['s' || (o_orderkey % 3), 'd' || (o_orderkey % 5)] END AS dbs, ['m' || (o_orderkey % 2)] AS mt,
   o_orderkey % 3 = 0 AS adm FROM orders)"""


@query(f"""WITH {_CHANGES}, st AS (SELECT c_custkey AS u, -1 AS seq, 'init' AS op, ['n' || c_nationkey] AS dbs, []::VARCHAR[] AS mt, false AS adm FROM customer WHERE c_custkey % 2 = 0),
 ls AS (SELECT u, list({{'op': op, 'dbs': dbs, 'mt': mt, 'adm': adm}} ORDER BY seq) AS l FROM (SELECT * FROM ev UNION ALL SELECT * FROM st) GROUP BY u),
 fin AS (SELECT u, list_reduce(list_transform(l, lambda e: {{'op': e.op, 'dbs': e.dbs, 'mt': e.mt, 'adm': e.adm, 'on': false}}), lambda s, e:
   CASE WHEN e.op IN ('add', 'init') THEN CASE WHEN s.on THEN s ELSE {{'op': 'x', 'dbs': e.dbs, 'mt': e.mt, 'adm': e.adm, 'on': true}} END
     WHEN NOT s.on THEN s WHEN e.op = 'delete' THEN {{'op': 'x', 'dbs': s.dbs, 'mt': s.mt, 'adm': s.adm, 'on': false}}
     WHEN e.op = 'set_dbs' THEN {{'op': 'x', 'dbs': e.dbs, 'mt': s.mt, 'adm': s.adm, 'on': true}} WHEN e.op = 'set_maintains' THEN {{'op': 'x', 'dbs': s.dbs, 'mt': e.mt, 'adm': s.adm, 'on': true}}
     ELSE {{'op': 'x', 'dbs': list_sort(list_distinct(list_concat(s.dbs, e.dbs))), 'mt': list_sort(list_distinct(list_concat(s.mt, e.dbs))), 'adm': s.adm, 'on': true}} END,
   {{'op': 'x', 'dbs': []::VARCHAR[], 'mt': []::VARCHAR[], 'adm': false, 'on': false}}) AS s FROM ls)
SELECT u AS username, array_to_string(s.dbs, ',') AS dbs, array_to_string(s.mt, ',') AS maintains, s.adm AS is_admin FROM fin WHERE s.on""")
def users_after_events(spark: SparkSession, sf: str) -> DataFrame:
    """Users added, deleted, granted and set by an ordered table of changes, several of them per user."""
    o, k = src.table(spark, sf, "orders"), F.col("o_orderkey")
    name = lambda head, n: F.concat(F.lit(head), (k % n).cast("string"))
    op = F.get(F.array(*[F.lit(x) for x in ("add", "delete", "set_dbs", "grant", "set_maintains", "grant", "add", "grant")]), (k % 8).cast("int"))
    events = o.select(F.col("o_custkey").alias("username"), k.alias("seq"), op.alias("op"), F.when((k % 8).isin(3, 5, 7), F.array(name("d", 7))).otherwise(
        F.array(name("s", 3), name("d", 5))).alias("dbs"), F.array(name("m", 2)).alias("maintains"), (k % 3 == 0).alias("is_admin"))
    users = src.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("username"), F.array(F.concat(F.lit("n"), "c_nationkey")).alias("dbs"), F.array().cast("array<string>").alias("maintains"), F.lit(False).alias("is_admin"))
    return access.after_events(users, events).select("username", F.array_join("dbs", ",").alias("dbs"), F.array_join("maintains", ",").alias("maintains"), "is_admin")


# --- asked queries --------------------------------------------------------------------------------------------

@query("""WITH q AS (SELECT event_id AS step, CASE WHEN event_id % 2 = 0 THEN 'wiki:' ELSE 'web:' END || lower(event_type) || ' of ' || (user_id % 40) AS key FROM events)
SELECT key, step, nullif(min(step) OVER (PARTITION BY key), step) AS prior_step FROM q""")
def fresh_queries(spark: SparkSession, sf: str) -> DataFrame:
    """U8: a stream of asked queries in three micro-batches, stopped after the first two and started again."""
    e, folder = src.table(spark, sf, "events"), _folder(spark, "asked")
    text = F.concat(F.lit("  "), F.when(F.col("event_id") % 3 == 0, F.upper("event_type")).otherwise(F.col("event_type")), F.lit(" of "), F.col("user_id") % 40, F.lit(" "))
    asked = e.select(F.when(F.col("event_id") % 2 == 0, "wiki").otherwise("web").alias("tool"), text.alias("query"), F.col("event_id").cast("bigint").alias("step"))
    bounds = e.agg(F.min("event_id"), F.max("event_id")).first()
    cuts = [bounds[0] + (bounds[1] + 1 - bounds[0]) * i // 3 for i in range(4)] if bounds[0] is not None else [0] * 4
    before, parts = spark.conf.get(seen.STORE, None), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(seen.STORE, seen.ROCKS)
    try:
        for i in range(3):
            asked.where((F.col("step") >= cuts[i]) & (F.col("step") < cuts[i + 1])).coalesce(1).write.mode("append").parquet(f"{folder}/in")
            if i:   # the second start finds the memory of the first
                stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
                run = (seen.seen_queries(stream).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress")
                       .outputMode("append").trigger(availableNow=True).start())
                run.awaitTermination()
    finally:
        spark.conf.unset(seen.STORE) if before is None else spark.conf.set(seen.STORE, before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    return spark.read.schema(seen.OUTPUT).parquet(f"{folder}/out").select("key", "step", "prior_step")


# --- retrieval quality with every kind of expected entry ----------------------------------------------------------

@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10)},
 want AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS token, item_id % 3 < 2 OR doc_id % 2 = 0 AS real, ['id', 'source', 'section'][item_id % 3 + 1] AS slice
    FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)),
 per AS (SELECT w.query_id, any_value(slice) AS slice, count(DISTINCT CASE WHEN rank < 5 THEN rank END) / 5.0 AS p,
    coalesce(count(DISTINCT CASE WHEN rank IS NOT NULL THEN token END) / nullif(count(DISTINCT token), 0), 0) AS r, coalesce(1.0 / (min(rank) + 1), 0) AS m
    FROM want w LEFT JOIN lex l ON l.query_id = w.query_id AND l.chunk_id = w.token AND w.real GROUP BY w.query_id)
SELECT coalesce(slice, 'ALL') AS slice, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(m), 6) AS mrr FROM per GROUP BY ROLLUP (slice)""")
def retrieval_metrics_by_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Expected entries by chunk id, by source, and by source and section (half of which name no section)."""
    docs, asked = src.chunks(spark, sf), src.benchmark_queries(spark, sf)
    found = lexical.search(docs, asked, matched_terms=False)
    hits = found.withColumn("source", F.concat(F.lit("doc-"), "chunk_id", F.lit(".md"))).withColumn("anchor", F.lit("§ 3 Limits")) \
        .withColumn("heading_path", F.array(F.lit("Part A"), F.lit("Annual Doses")))
    held = containing_documents(docs, asked)
    kind = F.col("query_id").cast("bigint") % 3
    name = F.concat(F.lit("doc-"), "token", F.lit(".md"))
    section = F.concat(name, F.when(F.col("token").cast("bigint") % 4 == 0, "# annual DOSES").when(F.col("token").cast("bigint") % 2 == 0, "#§ 3").otherwise("#nowhere"))
    expected = held.select("query_id", F.when(kind == 0, F.col("token")).when(kind == 1, name).otherwise(section).alias("token"))
    cases = asked.select("query_id", F.when(kind == 0, "id").when(kind == 1, "source").otherwise("section").alias("slice"))
    out = metrics.by_slice(metrics.per_query(cases, hits, expected))
    return out.select("slice", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")])


# --- answers of models ------------------------------------------------------------------------------------------------

@query("""SELECT doc_id, 'c' || doc_id AS chunk_id, unnest(CASE WHEN doc_id % 8 = 6 THEN ['5', 'true'] ELSE ['What is ' || doc_id || '?', 'Why ' || lang || '?'] END) AS question, NULL AS error
 FROM documents WHERE doc_id % 8 IN (0, 1, 2, 6) UNION ALL SELECT doc_id, NULL, NULL, CASE WHEN doc_id % 8 = 5 THEN 'no list' ELSE 'no JSON' END FROM documents WHERE doc_id % 8 IN (3, 4, 5)""")
def parsed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """fenced, bare, wrapped, broken, cut and wrong answers; odd entries left out, failures as rows."""
    d, n = src.table(spark, sf, "documents"), F.col("doc_id") % 8
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    good = cat('[{"chunk_id": " c', F.col("doc_id"), '", "questions": ["What is ', F.col("doc_id"), '?", "  ", " Why ', F.col("lang"),
                          '? "]}, "text", {"chunk_id": "other", "questions": ["x"]}, {"chunk_id": "c', F.col("doc_id"), '", "questions": 7}]')
    answer = (F.when(n == 0, cat("```json\n", good, "\n```\n")).when(n == 1, good).when(n == 2, cat("Sure! Here:\n", good, "\nDone."))
              .when(n == 3, F.left(good, F.length(good) - 3)).when(n == 4, "no questions today").when(n == 5, '{"chunk_id": "c"}')
              .when(n == 6, cat('[{"chunk_id": "c', F.col("doc_id"), '", "questions": [5, true]}]')).otherwise("[]"))
    rows = d.select(F.col("doc_id").alias("answer_id"), answer.alias("answer"))
    found, failed = reading.parsed_answers(rows, d.select(F.col("doc_id").alias("answer_id"), F.concat(F.lit("c"), "doc_id").alias("chunk_id")))
    return found.select(F.col("answer_id").alias("doc_id"), "chunk_id", "question", F.lit(None).cast("string").alias("error")).unionByName(
        failed.select(F.col("answer_id").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("question"), "error"))


# --- checked writes ----------------------------------------------------------------------------------------------------

def _untyped(rows: DataFrame) -> DataFrame:
    return rows.where(F.trim(F.coalesce("type", F.lit(""))) == "").select("filename")


@query("""SELECT 'page-' || doc_id || '.md' AS filename, CASE WHEN lang = 'en' THEN 'entity' ELSE 'concept' END AS type, 'main,' || CASE WHEN lang = 'en' THEN 'entity' ELSE 'concept' END AS tags,
  '2024-01-01T00:00:00Z' AS ts, 'Text of ' || doc_id || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '1. ' || source || '.md' || chr(10) AS body, 2 AS version FROM documents""")
def migrated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages stamped in one checked switch; a second change that loses types is refused and leaves no trace."""
    d = src.table(spark, sf, "documents")
    raw = d.select(*page_row(F.concat(F.lit("page-"), "doc_id", F.lit(".md")), F.concat(F.lit("Page "), "doc_id"), F.when(F.col("lang") == "en", "entity").otherwise(""),
                             F.array(F.concat("source", F.lit(".md"))), F.array().cast("array<string>"), F.concat(F.lit("Text of "), "doc_id")))
    table = SnapshotTable(spark, _folder(spark, "bundle"), ("db", "filename"), buckets=8)
    table.write(raw.withColumn("tags", F.array().cast("array<string>")).withColumn("timestamp", F.lit(None).cast("string")))
    table.merge(pages.finish(table.read()), check=_untyped)
    try:
        table.merge(table.read().withColumn("type", F.when(F.col("type") != "entity", F.col("type"))), check=_untyped)
    except ChangeRejected:
        pass
    return table.read().select("filename", "type", F.array_join("tags", ",").alias("tags"), F.col("timestamp").alias("ts"), "body", F.lit(table.version()).alias("version"))


@query("""WITH b AS (SELECT item_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS q FROM benchmark),
 s AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_replace(left(q, 80), '^\\s+|\\s+$', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM b),
 f AS (SELECT 'insight-' || CASE WHEN slug = '' THEN 'insight' ELSE slug END || '.md' AS filename, max(item_id) AS item_id FROM s GROUP BY 1)
SELECT filename, CASE WHEN regexp_replace(q, '[?.!]+$', '') = '' THEN 'Insight' ELSE regexp_replace(regexp_replace(q, '[?.!]+$', ''), '^\\s+|\\s+$', '', 'g') END AS title,
 '## Question' || chr(10) || q || chr(10) || chr(10) || '## Answer' || chr(10) || 'Answer ' || item_id || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '1. chat' || chr(10) AS body
FROM f JOIN s USING (item_id)""")
def filed_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answered questions filed as insight pages; of two that get one name the later one stays."""
    b = src.table(spark, sf, "benchmark")
    answers = b.select("item_id", F.lit("main").alias("db"), tx.strip(F.col("text")).alias("question"), F.concat(F.lit(" Answer "), "item_id", F.lit("\n")).alias("answer"),
                       F.array().cast("array<string>").alias("related"))
    filed = pages.filed_answers(answers, F.to_date(F.lit("2024-06-01")), keep=("item_id",))
    last = filed.groupBy("db", "filename").agg(F.max("item_id").alias("item_id"))
    rows = filed.join(last, ["db", "filename", "item_id"]).withColumn("part_of", F.lit(None).cast("string")).withColumn("description", F.lit(None).cast("string"))
    table = SnapshotTable(spark, _folder(spark, "insights"), ("db", "filename"), buckets=4)
    table.write(pages.finish(cut_lineage(rows)))
    return table.read().select("filename", "title", "body")
