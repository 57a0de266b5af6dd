"""The stored tables: built, changed by source, and then asked, next to one build of the end state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import dense, lexical, reading
from pagequarry.plans import inputs as src
from pagequarry.plans.search_queries import query as _query
from pagequarry.session import shared_folder
from pagequarry.sources.cascade import delete_everywhere
from pagequarry.sources.snapshots import SnapshotTable
from pagequarry.sources.tables import KnowledgeStore

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MODEL = "letters"
BUCKETS = 4


def query(oracle: str | None = None):
    return _query(oracle, QUERIES, ORACLES)


def _store(spark: SparkSession, sf: str) -> KnowledgeStore:
    store = KnowledgeStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    store.build(_chunks(spark, sf).drop("lang"))
    return store


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a chunk, with its place in its text and its language."""
    return src.table(spark, sf, "documents").select(
        F.regexp_replace("source", "[0-9]+", "").alias("db"), F.lit("raw").alias("scope"),
        F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source"), F.lit(0).alias("seq"),
        F.col("doc_id").cast("string").alias("chunk_id"), "text", "lang")


def _changed_store(spark: SparkSession, sf: str, vectors: str | None = None) -> KnowledgeStore:
    """German sources get a new text, Spanish ones go; vectors follow only where they are of the named model."""
    store = _store(spark, sf)
    if vectors:
        store.build_vectors(dense.letter_model, vectors)
    rows = _chunks(spark, sf)
    german = rows.where("lang = 'de'").withColumn("text", F.concat("text", F.lit(" zebra quagga zebra"))).drop("lang")
    store.replace_chunks(german.select("db", "source").distinct(), german, dense.letter_model, MODEL)
    store.delete(rows.where("lang = 'es'").select("db", "source").distinct())
    return store


_CHANGED = """SELECT regexp_replace(source, '[0-9]+', '', 'g') AS db, 'raw' AS scope, 'doc-' || doc_id || '.md' AS source,
  CAST(doc_id AS VARCHAR) AS chunk_id, CASE WHEN lang = 'de' THEN text || ' zebra quagga zebra' ELSE text END AS text
  FROM documents WHERE lang <> 'es'"""
_ASKED = "SELECT CAST(item_id AS VARCHAR) AS query_id, 'src' AS db, text || ' quagga' AS text FROM benchmark"


def _asked(spark: SparkSession, sf: str) -> DataFrame:
    return src.benchmark_queries(spark, sf).withColumn("text", F.concat("text", F.lit(" quagga")))


@query(f"""WITH {src.sql_bm25(_CHANGED, _ASKED, 10)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(bm25, 3) AS score, matched_terms FROM lex""")
def store_search_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 on stored tables after a replacement and a deletion."""
    hits = _changed_store(spark, sf).search(_asked(spark, sf))
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score",
                       F.array_join("matched_terms", ",").alias("matched_terms"))


_SEM = f"""WITH chunk_rows AS ({{chunks}}), query_rows AS ({_ASKED}), {src.sql_dense(10)}
SELECT query_id, CAST(rank AS BIGINT) AS rank, chunk_id, round(sim, 4) AS score FROM sem"""
_UNCHANGED_DE = _CHANGED.replace("CASE WHEN lang = 'de' THEN text || ' zebra quagga zebra' ELSE text END", "text")


def _near(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score")


@query(_SEM.format(chunks=_CHANGED))
def store_vectors_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Stored vectors follow a replacement and a deletion."""
    return _near(_changed_store(spark, sf, MODEL).search_vectors(_asked(spark, sf), dense.letter_model, MODEL))


@query(_SEM.format(chunks=_UNCHANGED_DE))
def store_vectors_of_another_model(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of another model are not replaced, only deleted."""
    return _near(_changed_store(spark, sf, "older").search_vectors(_asked(spark, sf), dense.letter_model, "older"))


@query("""WITH q AS (SELECT regexp_replace(source, '[0-9]+', '', 'g') AS db, 'doc-' || doc_id || '.md' AS source, lang FROM documents)
SELECT q.db, q.source, CASE WHEN lang = 'fr' THEN 0 ELSE 3 END AS kept, CASE WHEN lang = 'fr' THEN 3 ELSE 0 END AS removed FROM q""")
def store_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions appended twice, then deleted by source with a count per source."""
    store = _store(spark, sf)
    docs = _chunks(spark, sf)
    asked = docs.select("db", "source", "chunk_id", F.concat(F.lit("What about "), "chunk_id", F.lit("?")).alias("question"))
    store.add_questions(asked.unionByName(asked))
    store.add_questions(asked)
    gone = store.delete_questions(docs.where("lang = 'fr'").select("db", "source").distinct())
    left = store.questions.read().groupBy("db", "source").agg(F.count("*").alias("kept"))
    return (docs.select("db", "source").join(left, ["db", "source"], "left").join(gone, ["db", "source"], "left")
            .select("db", "source", F.coalesce("kept", F.lit(0)).cast("int").alias("kept"),
                    F.coalesce("removed", F.lit(0)).cast("int").alias("removed")))


@query("""WITH n AS (SELECT lang AS db, count(*) AS n FROM documents GROUP BY lang)
SELECT db, 'chunks' AS "table", CASE WHEN db IN ('de', 'fr') THEN n ELSE 0 END AS removed, CASE WHEN db IN ('de', 'fr') THEN 0 ELSE n END AS kept FROM n
UNION ALL SELECT db, 'lengths', CASE WHEN db IN ('de', 'fr') THEN n ELSE 0 END, CASE WHEN db IN ('de', 'fr') THEN 0 ELSE n END FROM n""")
def store_reset(spark: SparkSession, sf: str) -> DataFrame:
    """Two databases are emptied; rows removed and rows left per database and table."""
    store = KnowledgeStore(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}", BUCKETS)
    rows = _chunks(spark, sf)
    store.build(rows.withColumn("db", F.col("lang")).drop("lang"))
    gone = store.reset(spark.createDataFrame([("de",), ("fr",), ("no such db",)], "db string"))
    left = [t.read().groupBy("db").agg(F.count("*").alias("kept")).withColumn("table", F.lit(n))
            for n, t in (("chunks", store.chunks), ("lengths", store.lengths))]
    names = rows.select(F.col("lang").alias("db")).distinct().select("db", F.explode(F.array(F.lit("chunks"), F.lit("lengths"))).alias("table"))
    return (names.join(left[0].unionByName(left[1]), ["db", "table"], "left").join(gone, ["db", "table"], "left")
            .select("db", "table", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("kept", F.lit(0)).alias("kept")))


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10)}, d AS (SELECT *, trim(replace(text, chr(10), ' ')) AS flat FROM documents)
SELECT query_id, CAST(rank AS BIGINT) AS rank, lex.chunk_id, round(bm25, 3) AS score, lex.source, lex.scope, 'p' || (doc_id % 7) AS anchor,
  'Doc > p' || (doc_id % 7) AS heading_path, CAST(10 * doc_id AS BIGINT) AS char_start, CAST(10 * doc_id + length(text) AS BIGINT) AS char_end, lang, text,
  CASE WHEN length(flat) > 320 THEN left(flat, 320) || '…' ELSE flat END AS preview, matched_terms
FROM lex JOIN d ON lex.chunk_id = CAST(d.doc_id AS VARCHAR)""")
def full_hit_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Hits with every column a hit has."""
    rows = _chunks(spark, sf)
    n = F.col("chunk_id").cast("long")
    anchor = F.concat(F.lit("p"), n % 7)
    rows = rows.select("*", anchor.alias("anchor"), F.array(F.lit("Doc"), anchor).alias("heading_path"), (10 * n).alias("char_start"),
                       (10 * n + F.length("text")).alias("char_end"))
    hits = lexical.hit_rows(lexical.search(rows, src.benchmark_queries(spark, sf)), rows)
    return hits.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "score", "source", "scope", "anchor",
                       F.array_join("heading_path", " > ").alias("heading_path"), "char_start", "char_end", "lang", "text", "preview",
                       F.array_join("matched_terms", ",").alias("matched_terms"))


@query("""WITH r AS (SELECT item_id, 'doc-' || CASE WHEN item_id % 3 = 0 THEN -1 - item_id ELSE item_id END || '.md' AS filename FROM benchmark)
SELECT item_id AS request_id, r.filename, coalesce(d.text, 'Page not found: ' || r.filename) AS content, d.doc_id IS NOT NULL AS found,
  coalesce(d.source, '') AS sources FROM r LEFT JOIN documents d ON r.filename = 'doc-' || d.doc_id || '.md'""")
def page_point_reads(spark: SparkSession, sf: str) -> DataFrame:
    """Requested pages with body and sources; a missing page is a message."""
    pages = src.table(spark, sf, "documents").select(
        F.lit("main").alias("db"), F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("filename"), F.col("text").alias("body"),
        F.array("source").alias("sources"), F.array().cast("array<string>").alias("related"))
    n = F.col("item_id")
    asked = src.table(spark, sf, "benchmark").select(
        n.alias("request_id"), F.lit("main").alias("db"), F.concat(F.lit("doc-"), F.when(n % 3 == 0, -1 - n).otherwise(n), F.lit(".md")).alias("filename"))
    out = reading.read_pages(pages, asked)
    return out.select("request_id", "filename", "content", "found", F.array_join("sources", ",").alias("sources"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'active' WHEN c_nationkey + 1 = 3 THEN 'nation-3'
  ELSE 'nation-3,nation-' || (c_nationkey + 1) END AS dbs FROM customer""")
def allowed_databases(spark: SparkSession, sf: str) -> DataFrame:
    """Chosen databases that are allowed, in the order chosen; the active one where none is."""
    n = F.col("c_nationkey")
    name = lambda x: F.concat(F.lit("nation-"), x.cast("string"))
    users = src.table(spark, sf, "customer").select(
        "c_custkey", F.array(name(n), name(n + 1), F.lit("nation-3")).alias("allowed"),
        F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("nation-3"), name(n + 1), F.lit("nation-77"))).otherwise(
            F.array(F.lit("nation-77"))).alias("chosen"))
    return users.select("c_custkey", F.array_join(reading.search_scope(F.col("chosen"), F.col("allowed"), F.lit("active")), ",").alias("dbs"))


@query("""WITH gone AS (SELECT source FROM documents GROUP BY source HAVING avg(n_chars) > 2500), d AS (SELECT *, source IN (SELECT source FROM gone) AS g FROM documents),
 hit AS (SELECT doc_id, lang, EXISTS (SELECT 1 FROM gone WHERE starts_with(d.source || '.md', gone.source)) AS p FROM d), rm AS (SELECT doc_id FROM hit WHERE p AND lang = 'en'),
 c AS (SELECT 'chunks' AS "table", CAST(doc_id AS VARCHAR) AS key FROM d WHERE NOT g UNION ALL SELECT 'questions', 'why ' || doc_id FROM d WHERE NOT g AND lang = 'de'
  UNION ALL SELECT DISTINCT 'manifest', source || '/' || copy FROM d, (SELECT unnest(['a', 'b']) AS copy) WHERE NOT g OR copy = 'b'
  UNION ALL SELECT 'pages', 'page-' || doc_id || '.md/' || CASE WHEN doc_id + 1 IN (SELECT doc_id FROM rm) THEN 0 ELSE 1 END FROM hit WHERE doc_id NOT IN (SELECT doc_id FROM rm)),
 n AS (SELECT 'chunks' AS t, count(*) AS n FROM d WHERE g UNION ALL SELECT 'questions', count(*) FROM d WHERE g AND lang = 'de' UNION ALL SELECT 'manifest', count(*) FROM gone UNION ALL SELECT 'pages', count(*) FROM rm)
SELECT "table", key, 0 AS removed FROM c UNION ALL SELECT t, NULL, n FROM n WHERE n > 0""")
def cascade_all_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Sources leave the manifest, the chunks and all that is built on them, the questions and the pages; what is left, and the counts."""
    d, folder = src.table(spark, sf, "documents"), f"{shared_folder(spark)}/cascade-{uuid.uuid4().hex}"
    day = F.to_date(F.lit("2024-01-01"))
    store = KnowledgeStore(spark, f"{folder}/store", BUCKETS)
    store.build(d.select(F.lit("src").alias("db"), F.lit("raw").alias("scope"), "source", F.col("doc_id").cast("int").alias("seq"),
                         F.col("doc_id").cast("string").alias("chunk_id"), "text"))
    store.add_questions(d.where("lang = 'de'").select(F.lit("src").alias("db"), "source", F.col("doc_id").cast("string").alias("chunk_id"),
                                                      F.concat(F.lit("why "), "doc_id").alias("question")))
    manifest = SnapshotTable(spark, f"{folder}/manifest", ("db", "filename", "sha256"), buckets=4)
    manifest.write(d.select("source").distinct().select(F.lit("src").alias("db"), F.col("source").alias("filename"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("sha256")))
    pages = SnapshotTable(spark, f"{folder}/pages", ("db", "filename"), buckets=4)
    own = F.concat(F.lit("own-"), "doc_id", F.lit(".txt"))
    pages.write(d.select(F.lit("src").alias("db"), F.concat(F.lit("page-"), "doc_id", F.lit(".md")).alias("filename"),
                         F.when(F.col("lang") == "en", F.array(F.concat("source", F.lit(".md")))).otherwise(F.array(F.concat("source", F.lit(".md")), own)).alias("sources"),
                         F.array(F.concat(F.lit("page-"), F.col("doc_id") + 1, F.lit(".md"))).alias("related"), day.alias("updated")))
    gone = d.groupBy("source").agg(F.avg("n_chars").alias("n")).where("n > 2500").select(F.lit("src").alias("db"), "source")
    counts = delete_everywhere(gone, store, manifest, pages, F.to_date(F.lit("2030-01-01")))
    left = (store.chunks.read().select(F.lit("chunks").alias("table"), F.col("chunk_id").alias("key"))
            .unionByName(store.questions.read().select(F.lit("questions").alias("table"), F.col("question").alias("key")))
            .unionByName(manifest.read().select(F.lit("manifest").alias("table"), F.concat_ws("/", "filename", "sha256").alias("key")))
            .unionByName(pages.read().select(F.lit("pages").alias("table"), F.concat("filename", F.lit("/"), F.size("related")).alias("key"))))
    told = counts.where(F.col("table").isin("chunks", "questions", "manifest", "pages"))
    return left.select("table", "key", F.lit(0).cast("long").alias("removed")).unionByName(told.select("table", F.lit(None).cast("string").alias("key"), "removed"))
