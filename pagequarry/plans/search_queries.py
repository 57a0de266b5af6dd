"""Search: postings, BM25, vectors, fusion, re-ranking, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import scores as sc
from pagequarry.functions.words import explode_words, word_forms
from pagequarry.operators import answering, dense, fusion, lexical, metrics
from pagequarry.plans import inputs as src
from pagequarry.session import BROADCAST_ROWS, cut_lineage, is_small

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, queries: dict = QUERIES, oracles: dict = ORACLES):
    """Registers a query under its own name, with its oracle where there is one."""
    def add(fn):
        queries[fn.__name__] = fn
        if oracle is not None:
            oracles[fn.__name__] = oracle
        return fn
    return add


_RANK = "CAST(rank AS BIGINT) AS rank"


def _rank() -> F.Column:
    return F.col("rank").cast("long").alias("rank")


def _terms(name: str = "matched_terms"):
    return F.array_join(name, ",").alias("matched_terms")


# --- terms and postings ------------------------------------------------------------------------

_FORMS = f"""SELECT tok AS token, array_to_string(list_sort(list_distinct([tok, nf,
  replace(replace(replace(replace(tok, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), {src.sql_stem('nf')}])), ',') AS forms,
  count(*) AS n FROM (SELECT tok, strip_accents(tok) AS nf FROM (SELECT lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS tok
  FROM documents) WHERE length(tok) >= 2 AND tok NOT IN ({src._STOP})) GROUP BY ALL"""


@query(_FORMS)
def word_forms_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Every index word of the corpus with its forms and frequency."""
    words = explode_words(src.table(spark, sf, "documents"), F.col("text"), ["doc_id"])
    counted = words.groupBy("token", "folded", "stemmed").agg(F.count("*").alias("n"))
    forms = F.array_sort(word_forms(F.col("token"), F.col("folded"), F.col("stemmed")))
    return counted.select("token", F.array_join(forms, ",").alias("forms"), "n")


@query(f"""WITH t AS {src.sql_terms('documents', 'doc_id')}, tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL)
SELECT CAST(doc_id AS VARCHAR) AS chunk_id, term, tf, CAST(sum(CASE WHEN contains(term, '_') THEN 0 ELSE tf END)
  OVER (PARTITION BY doc_id) AS BIGINT) AS length FROM tf""")
def postings(spark: SparkSession, sf: str) -> DataFrame:
    """A1, K4: the full postings table."""
    return lexical.build_postings(src.chunks(spark, sf)).rows.select("chunk_id", "term", "tf", "length")


@query(f"""WITH t AS {src.sql_terms('documents', 'doc_id')}, d AS (SELECT term, count(DISTINCT doc_id) AS df FROM t GROUP BY term)
SELECT term, df, round(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6), 6) AS idf FROM d, (SELECT count(*) AS n FROM documents)""")
def term_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """A2: document frequency and idf of every term."""
    made = lexical.build_postings(src.chunks(spark, sf))
    return lexical.term_statistics(made).select("term", "df", F.round("idf", 6).alias("idf"))


# --- BM25 ------------------------------------------------------------------------------------------

_BM25 = f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10)}
SELECT query_id, {_RANK}, chunk_id, round(bm25, 3) AS score, matched_terms FROM lex"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", _rank(), "chunk_id", "score", _terms())


@query(_BM25)
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: every benchmark passage as a query over all documents."""
    return _shown(lexical.search(src.chunks(spark, sf), src.benchmark_queries(spark, sf)))


@query(_BM25)
def bm25_stored_index(spark: SparkSession, sf: str) -> DataFrame:
    """Q1 on a stored postings table."""
    kept = lexical.build_postings(src.chunks(spark, sf))
    return _shown(lexical.search_postings(kept, src.benchmark_queries(spark, sf)))


_LANG_CHUNKS = """SELECT regexp_replace(source, '[0-9]+', '', 'g') AS db, lang AS scope,
  'doc-' || doc_id || '.md' AS source, CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents"""


@query(f"""WITH {src.sql_bm25(_LANG_CHUNKS, src.SQL_QUERIES, 10, extra="WHERE t.scope = 'en'")}
SELECT query_id, {_RANK}, chunk_id, round(bm25, 3) AS score, matched_terms FROM lex""")
def bm25_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Hits of one scope, statistics over all scopes."""
    docs = src.table(spark, sf, "documents").select("doc_id", "lang")
    scoped = (src.chunks(spark, sf).drop("scope").withColumn("doc_id", F.col("chunk_id").cast("long"))
              .join(docs.withColumnRenamed("lang", "scope"), "doc_id").drop("doc_id"))
    asked = src.benchmark_queries(spark, sf).withColumn("scope", F.lit("en"))
    return _shown(lexical.search(scoped, asked))


_DB_QUERIES = """SELECT CAST(item_id AS VARCHAR) AS query_id, d.lang AS db, text FROM benchmark,
  (SELECT DISTINCT lang FROM documents) d"""
_DB_CHUNKS = """SELECT lang AS db, 'raw' AS scope, 'doc-' || doc_id || '.md' AS source,
  CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents"""


@query(f"""WITH {src.sql_bm25(_DB_CHUNKS, _DB_QUERIES, 3)}
SELECT query_id, db, {_RANK}, db || '::' || source AS file, round(bm25, 3) AS score FROM lex""")
def multi_db_search(spark: SparkSession, sf: str) -> DataFrame:
    """Each query in every database, budget split, names qualified."""
    dbs = src.table(spark, sf, "documents").agg(F.collect_set("lang").alias("dbs"))
    n_dbs = dbs.select(F.size("dbs")).first()[0]
    base = src.table(spark, sf, "benchmark")
    asked = base.withColumn("one", F.lit(1)).join(dbs.withColumn("one", F.lit(1)), "one").select(
        F.col("item_id").cast("string").alias("query_id"), F.explode("dbs").alias("db"), "text")
    hits = lexical.search(src.chunks(spark, sf, "lang"), asked, lexical.per_db_budget(6, n_dbs), matched_terms=False)
    return answering.search_text(
        hits.withColumn("matched_terms", F.array().cast("array<string>")).withColumn("preview", F.lit("")), n_dbs).select(
        "query_id", "db", _rank(), F.regexp_extract("block", r"file: (\S+)", 1).alias("file"), "score")


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10)},
flat AS (SELECT chunk_id, trim(replace(text, chr(10), ' ')) AS t FROM chunk_rows)
SELECT query_id, {_RANK}, chunk_id, CASE WHEN length(t) > 320 THEN left(t, 320) || '…' ELSE t END AS preview
FROM lex JOIN flat USING (chunk_id)""")
def hits_with_preview(spark: SparkSession, sf: str) -> DataFrame:
    """Hits joined to their texts."""
    docs = src.chunks(spark, sf)
    hits = lexical.search(docs, src.benchmark_queries(spark, sf), matched_terms=False)
    return lexical.present(lexical.with_text(hits, docs)).select("query_id", _rank(), "chunk_id", "preview")


_FOLDED = "SELECT db, scope, source, chunk_id, text FROM chunk_rows UNION ALL SELECT c.db, c.scope, c.source, c.chunk_id, b.text " \
          "FROM chunk_rows c JOIN benchmark b ON c.chunk_id = CAST(b.item_id AS VARCHAR)"


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10, texts=_FOLDED)}
SELECT query_id, {_RANK}, chunk_id, round(bm25, 3) AS score, matched_terms FROM lex""")
def questions_fold_into_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages as questions of the document of equal number."""
    docs = src.chunks(spark, sf)
    asked = src.benchmark_queries(spark, sf)
    texts = lexical.with_questions(docs, asked.select("db", F.col("query_id").alias("chunk_id"), F.col("text").alias("question")))
    return _shown(lexical.search(docs, asked, texts=texts))


@query("""SELECT db, CAST(sum(CASE WHEN scope = 'raw' THEN 1 ELSE 0 END) AS BIGINT) AS raw,
  CAST(sum(CASE WHEN scope = 'wiki' THEN 1 ELSE 0 END) AS BIGINT) AS wiki FROM (
  SELECT lang AS db, 'raw' AS scope FROM documents UNION ALL SELECT role, 'wiki' FROM conversations) GROUP BY db""")
def index_health(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per scope, zero where a scope is empty."""
    raw = src.table(spark, sf, "documents").select(F.col("lang").alias("db"), F.lit("raw").alias("scope"))
    wiki = src.table(spark, sf, "conversations").select(F.col("role").alias("db"), F.lit("wiki").alias("scope"))
    return lexical.health(raw.unionByName(wiki))


# --- vectors --------------------------------------------------------------------------------------------

def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "embeddings").select(
        F.lit("main").alias("db"), F.concat(F.lit("label-"), "label").alias("scope"),
        F.col("vec_id").cast("string").alias("source"), F.col("vec_id").cast("string").alias("chunk_id"),
        sc.unit(F.col("embedding")).alias("vec"), "label")


def _centroids(vectors: DataFrame) -> DataFrame:
    """One query per label: the mean of its vectors."""
    means = vectors.select("label", F.posexplode("vec").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    return (means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
            .select(F.col("label").cast("string").alias("query_id"), F.lit("main").alias("db"), sc.unit(F.col("mean")).alias("vec")))


_UNITS = """u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / n) AS vec FROM (SELECT *,
    sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings)),
  m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(vec) AS x, generate_subscripts(vec, 1) AS i FROM u) GROUP BY ALL),
  c AS (SELECT label AS q, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS qv
        FROM (SELECT label, list(x ORDER BY i) AS v FROM m GROUP BY label)),
  s AS (SELECT q, vec_id, label, list_inner_product(vec, qv) AS sim FROM u, c)"""


@query(f"""WITH {_UNITS} SELECT CAST(q AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, round(sim, 4) AS score,
  CAST(row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, CAST(vec_id AS VARCHAR)) - 1 AS BIGINT) AS rank
  FROM s QUALIFY rank < 10""")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest vectors of every label centroid."""
    vectors = _vectors(spark, sf)
    return dense.nearest(vectors, _centroids(vectors)).select("query_id", "chunk_id", "score", _rank())


@query(f"""WITH {_UNITS} SELECT CAST(q AS VARCHAR) AS query_id, CAST(vec_id AS VARCHAR) AS chunk_id, round(sim, 4) AS score,
  CAST(row_number() OVER (PARTITION BY q ORDER BY round(sim, 6) DESC, CAST(vec_id AS VARCHAR)) - 1 AS BIGINT) AS rank
  FROM s WHERE label = q QUALIFY rank < 10""")
def dense_topk_scope(spark: SparkSession, sf: str) -> DataFrame:
    """P2 on the dense arm: only vectors of the query's own scope count."""
    vectors = _vectors(spark, sf)
    asked = _centroids(vectors).withColumn("scope", F.concat(F.lit("label-"), "query_id"))
    return dense.nearest(vectors, asked).select("query_id", "chunk_id", "score", _rank())


# --- fusion and re-ranking -------------------------------------------------------------------------------

_ARMS = f"{src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, fv.ARM_DEPTH)}, {src.sql_dense(fv.ARM_DEPTH)}"


@query(f"""WITH {_ARMS}, {src.sql_fused(10)} SELECT query_id, {_RANK}, chunk_id, round(rrf, 4) AS score,
  coalesce(matched_terms, '') AS matched_terms FROM fused""")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Both arms 40 deep, fused."""
    return _shown(fusion.hybrid(src.chunks(spark, sf), src.benchmark_queries(spark, sf)))


_OVERLAP = """list_unique(list_intersect(list_transform(regexp_extract_all(q.text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x)),
   list_transform(regexp_extract_all(left(c.text, 4000), '[\\p{L}\\p{N}_]+'), lambda x: lower(x))))
   / greatest(list_unique(list_transform(regexp_extract_all(q.text, '[\\p{L}\\p{N}_]+'), lambda x: lower(x))), 1)"""
_BLEND = f"""{_ARMS}, {src.sql_fused(fv.RERANK_DEPTH)},
  second AS (SELECT f.*, round(rrf, 4) AS fscore, CAST({_OVERLAP} AS DOUBLE) AS logit FROM fused f
     JOIN chunk_rows c USING (chunk_id) JOIN query_rows q USING (query_id)),
  span AS (SELECT *, min(fscore) OVER w AS f0, max(fscore) OVER w AS f1, min(logit) OVER w AS l0, max(logit) OVER w AS l1
     FROM second WINDOW w AS (PARTITION BY query_id)),
  mixed AS (SELECT *, CASE WHEN rank < 3 THEN 0.25 WHEN rank < 10 THEN 0.4 ELSE 0.5 END AS w,
     CASE WHEN f1 - f0 < 1e-9 THEN 0.5 ELSE (fscore - f0) / (f1 - f0) END AS fn,
     CASE WHEN l1 - l0 < 1e-9 THEN 0.5 ELSE (logit - l0) / (l1 - l0) END AS ln FROM span),
  final AS (SELECT query_id, chunk_id, round((1 - w) * fn + w * ln, 4) AS score, round(logit, 4) AS rerank_score,
     row_number() OVER (PARTITION BY query_id ORDER BY round((1 - w) * fn + w * ln, 4) DESC, rank) - 1 AS pos FROM mixed
     QUALIFY pos < 10)"""


@query(f"WITH {_BLEND} SELECT query_id, CAST(pos AS BIGINT) AS rank, chunk_id, score, rerank_score FROM final")
def rerank_blend(spark: SparkSession, sf: str) -> DataFrame:
    """Fused list blended with shared words."""
    hits = fusion.hybrid(src.chunks(spark, sf), src.benchmark_queries(spark, sf), scorer=fusion.shared_words)
    return hits.select("query_id", _rank(), "chunk_id", "score", "rerank_score")


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 10)},
 want AS (SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS token,
    CASE WHEN length(b.text) > 250 THEN 'long' ELSE 'short' END AS slice
    FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text)),
 per AS (SELECT w.query_id, any_value(slice) AS slice, count(DISTINCT CASE WHEN rank < 5 THEN rank END) / 5.0 AS p,
    coalesce(count(DISTINCT CASE WHEN rank IS NOT NULL THEN token END) / nullif(count(DISTINCT token), 0), 0) AS r,
    coalesce(1.0 / (min(rank) + 1), 0) AS m
    FROM want w LEFT JOIN lex l ON l.query_id = w.query_id AND l.chunk_id = w.token GROUP BY w.query_id)
SELECT coalesce(slice, 'ALL') AS slice, count(*) AS n, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall,
  round(avg(m), 6) AS mrr FROM per GROUP BY ROLLUP (slice)""")
def retrieval_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """A document that contains the whole passage is an expected hit."""
    docs, asked = src.chunks(spark, sf), src.benchmark_queries(spark, sf)
    # a containing document is found among the documents that share the passage's rarest words:
    # every word of a contained passage is a word of the document, so a full word match decides
    hits = lexical.search(docs, asked, matched_terms=False).withColumn("anchor", F.lit("")) \
        .withColumn("heading_path", F.array().cast("array<string>"))
    expected = containing_documents(docs, asked)
    cases = asked.select("query_id", F.when(F.length("text") > 250, "long").otherwise("short").alias("slice"))
    out = metrics.by_slice(metrics.per_query(cases, hits, expected))
    return out.select("slice", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "mrr")])


PASSAGES_PER_BLOCK = 1000


def containing_documents(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, token): documents that hold a query text literally.

    Candidates come from an equi-join on the rarest full word of the passage, then the
    literal test runs on the few documents left; nothing is compared with everything.  Few
    candidates are sent to the texts, which are tested where they are read; to many, texts are
    dealt by counted bytes.  Only passages without a full word inside (one or two words, or stop
    words alone) are looked for in every document, block by block.
    """
    inner = explode_words(asked, F.regexp_replace("text", r"^\S+|\S+$", ""), ["query_id"]).select("query_id", "token").distinct()
    rows, deal = lexical.dealt_texts(docs, ["chunk_id"])
    keys = [lexical.BUCKET, "chunk_id", "token"]
    words = explode_words(rows, F.col("text"), keys[:2], deal).select(*keys) \
        .join(lexical.bounded_broadcast(inner.select("token").distinct()), "token", "left_semi").select(*keys).distinct()
    words = cut_lineage(words.drop(lexical.BUCKET))
    freq = words.groupBy("token").agg(F.count("*").alias("df"))
    rare = cut_lineage(inner.join(freq, "token").groupBy("query_id").agg(F.min(F.struct("df", "token")).alias("r"))
                       .select("query_id", F.col("r.token").alias("token")))
    pairs = cut_lineage(words.join(lexical.bounded_broadcast(rare), "token").select("query_id", "chunk_id"))
    texts, passages = docs.select("chunk_id", "text"), asked.select("query_id", F.col("text").alias("passage"))
    met = texts.join(F.broadcast(pairs), "chunk_id").join(F.broadcast(passages), "query_id") \
        if is_small(pairs) and is_small(passages) else \
        deal(rows, "chunk_id").select("chunk_id", "text").join(pairs.join(passages, "query_id"), "chunk_id")
    found = met.where(F.col("text").contains(F.col("passage"))).select("query_id", F.col("chunk_id").alias("token"))
    short = cut_lineage(asked.join(inner.select("query_id").distinct(), "query_id", "left_anti").where("text <> ''")
                        .select("query_id", F.col("text").alias("passage")))
    n_blocks = -(-short.count() // PASSAGES_PER_BLOCK)
    if not n_blocks:
        return found
    block = F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))
    blocks = lexical.bounded_broadcast(short.groupBy(block.alias("block")).agg(
        F.collect_list(F.struct("query_id", "passage")).alias("passages")), BROADCAST_ROWS // PASSAGES_PER_BLOCK)
    met = texts.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, "block")
    inside = F.filter("passages", lambda p: F.col("text").contains(p["passage"]))
    return found.unionByName(met.select(F.explode(inside).alias("p"), "chunk_id").select("p.query_id", F.col("chunk_id").alias("token")))


# --- page queries over hits -----------------------------------------------------------------------------------

def _collection_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per collection and language; its sources are the documents of both."""
    return src.table(spark, sf, "documents").select(
        F.lit("src").alias("db"), F.concat("source", F.lit("-"), "lang", F.lit(".md")).alias("filename"),
        F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source"))


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 20)},
 link AS (SELECT source || '-' || lang || '.md' AS filename, 'doc-' || doc_id || '.md' AS source FROM documents),
 total AS (SELECT query_id, filename, sum(round(bm25, 3)) AS total FROM lex JOIN link USING (source) GROUP BY ALL)
SELECT query_id, filename, round(total, 3) AS total,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(total, 6) DESC, filename) - 1 AS BIGINT) AS rank
FROM total QUALIFY rank < 5""")
def affected_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages behind the hits of a new text."""
    hits = lexical.search(src.chunks(spark, sf), src.benchmark_queries(spark, sf), fv.AFFECTED_HITS, matched_terms=False)
    pages = _collection_pages(spark, sf).select("db", "filename", F.array("source").alias("sources"))
    return answering.affected_pages(hits, pages).select("query_id", "filename", F.round("total", 3).alias("total"), _rank())


_PAGE_CHUNKS = """SELECT 'src' AS db, 'wiki' AS scope, source || '.md' AS source, CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents"""


@query(f"""WITH {src.sql_bm25(_PAGE_CHUNKS, src.SQL_QUERIES, 30)},
 one AS (SELECT * FROM lex QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1)
SELECT query_id, source AS filename, 'Collection ' || replace(source, '.md', '') AS title, round(bm25, 3) AS score, {_RANK} FROM one""")
def search_pages_best_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """One row per page, its best chunk counts."""
    docs = src.table(spark, sf, "documents")
    chunks = docs.select(F.regexp_replace("source", "[0-9]+", "").alias("db"), F.lit("wiki").alias("scope"),
                         F.concat("source", F.lit(".md")).alias("source"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    pages = docs.select("source").distinct().select(
        F.lit("src").alias("db"), F.concat("source", F.lit(".md")).alias("filename"), F.concat(F.lit("Collection "), "source").alias("title"))
    found = answering.search_pages(chunks, pages, src.benchmark_queries(spark, sf))
    return found.select("query_id", "filename", "title", "score", _rank())


@query(f"""WITH {src.sql_bm25(src.SQL_CHUNKS, src.SQL_QUERIES, 15)},
 link AS (SELECT source || '-' || lang || '.md' AS filename, 'doc-' || doc_id || '.md' AS source FROM documents),
 firsts AS (SELECT query_id, filename, min(rank) AS first_at FROM lex JOIN link USING (source) GROUP BY ALL)
SELECT query_id, filename, CAST(row_number() OVER (PARTITION BY query_id ORDER BY first_at, filename) - 1 AS BIGINT) AS ord
FROM firsts QUALIFY ord < 10""")
def candidate_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages behind raw hits in order of first arrival, at most ten."""
    hits = lexical.search(src.chunks(spark, sf), src.benchmark_queries(spark, sf), fv.CANDIDATE_HITS, matched_terms=False)
    pages = _collection_pages(spark, sf).select("db", "filename", F.array("source").alias("sources"))
    none = hits.where(F.lit(False))
    return answering.candidate_pages(none, hits, pages).select("query_id", "filename", F.col("ord").cast("long").alias("ord"))


@query(f"""WITH {src.sql_bm25(_PAGE_CHUNKS, src.SQL_QUERIES, 15)},
 pages AS (SELECT query_id, source, min(rank) AS first FROM lex GROUP BY ALL),
 sel AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, source) - 1 AS ord FROM pages QUALIFY ord < 5),
 part AS (SELECT l.query_id, l.source, s.ord, row_number() OVER (PARTITION BY l.query_id, l.source ORDER BY rank) AS part,
    chr(10) || chr(10) || '--- ' || l.source || ' ---' || chr(10) || c.text AS block
    FROM lex l JOIN sel s USING (query_id, source) JOIN chunk_rows c USING (chunk_id) QUALIFY part <= 2),
 run AS (SELECT *, coalesce(sum(length(block)) OVER (PARTITION BY query_id ORDER BY ord, part
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM part)
SELECT query_id, CAST(ord AS BIGINT) AS ord, source AS filename, CAST(part AS BIGINT) AS part,
  CAST(least(length(block), 8000 - before) AS BIGINT) AS taken,
  left(block, CAST(least(length(block), 8000 - before) AS BIGINT)) AS block FROM run WHERE before < 8000""")
def gather_context(spark: SparkSession, sf: str) -> DataFrame:
    """Two chunks per selected page within 8,000 characters."""
    docs = src.table(spark, sf, "documents")
    chunks = docs.select(F.regexp_replace("source", "[0-9]+", "").alias("db"), F.lit("wiki").alias("scope"),
                         F.concat("source", F.lit(".md")).alias("source"), F.col("doc_id").cast("string").alias("chunk_id"),
                         "text", F.lit("").alias("anchor"))
    pages = docs.select("source").distinct().select(
        F.lit("src").alias("db"), F.concat("source", F.lit(".md")).alias("filename"), F.lit("").alias("body"),
        F.array().cast("array<string>").alias("sources"))
    hits = cut_lineage(lexical.search(chunks, src.benchmark_queries(spark, sf), fv.CANDIDATE_HITS, matched_terms=False))
    chosen = answering.selected_pages(answering.candidate_pages(hits, hits.where(F.lit(False)), pages))
    out = answering.gather(chosen, hits, chunks, pages)
    return out.select("query_id", F.col("ord").cast("long").alias("ord"), "filename", F.col("part").cast("long").alias("part"),
                      F.col("taken").cast("long").alias("taken"), "block")
