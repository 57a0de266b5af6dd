"""Engine tables derived from the test tables, row by row, with the same rules in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- documents as chunks ---------------------------------------------------------------

def chunks(spark: SparkSession, folder: str, db: str = "source") -> DataFrame:
    """Every document is one chunk; the database is its collection (src) or its language."""
    name = F.regexp_replace("source", "[0-9]+", "") if db == "source" else F.col("lang")
    return table(spark, folder, "documents").select(
        name.alias("db"), F.lit("raw").alias("scope"), F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source"),
        F.col("doc_id").cast("string").alias("chunk_id"), "text")


def benchmark_queries(spark: SparkSession, folder: str, db: str = "src") -> DataFrame:
    return table(spark, folder, "benchmark").select(
        F.col("item_id").cast("string").alias("query_id"), F.lit(db).alias("db"), "text")


def markdown(text: Column) -> Column:
    """Paragraph per line; lines of 1, 2, 3-4 and 5-6 words become headings of level 2, 3, 4, 1."""
    out = F.replace(text, F.lit("\n"), F.lit("\n\n"))
    for pattern, mark in MARKDOWN_RULES:
        out = F.regexp_replace(out, "(?md)" + pattern, f"{mark} $1")
    return out


def legal_markdown(text: Column) -> Column:
    """Lines of 1, 2 and 3-4 words become paragraph headings."""
    out = F.replace(text, F.lit("\n"), F.lit("\n\n"))
    for pattern, mark in LEGAL_RULES:
        out = F.regexp_replace(out, "(?md)" + pattern, f"{mark} $1")
    return out


MARKDOWN_RULES = ((r"^([^\s#]+)$", "##"), (r"^([^\s#]+ [^\s]+)$", "###"),
                  (r"^([^\s#]+(?: [^\s]+){2,3})$", "####"), (r"^([^\s#]+(?: [^\s]+){4,5})$", "#"))
LEGAL_RULES = ((r"^([^\s#]+)$", "## § 1"), (r"^([^\s#]+ [^\s]+)$", "## § 2a"),
               (r"^([^\s#]+(?: [^\s]+){2,3})$", "### § 3"))


def documents_as(spark: SparkSession, folder: str, markup) -> DataFrame:
    """db, source, text of every document under a markup rule."""
    return table(spark, folder, "documents").select(
        "lang", F.col("doc_id"), F.regexp_replace("source", "[0-9]+", "").alias("db"),
        F.concat(F.lit("doc-"), "doc_id", F.lit(".md")).alias("source"), markup(F.col("text")).alias("text"))


# --- the same rules in DuckDB SQL ---------------------------------------------------------

def sql_markup(column: str, rules) -> str:
    out = f"replace({column}, chr(10), chr(10) || chr(10))"
    for pattern, mark in rules:
        out = f"regexp_replace({out}, '(?m){pattern}', '{mark} \\1', 'g')"
    return out


SQL_CHUNKS = """SELECT regexp_replace(source, '[0-9]+', '', 'g') AS db, 'raw' AS scope,
  'doc-' || doc_id || '.md' AS source, CAST(doc_id AS VARCHAR) AS chunk_id, text FROM documents"""
SQL_QUERIES = "SELECT CAST(item_id AS VARCHAR) AS query_id, 'src' AS db, text FROM benchmark"

_STOP = ", ".join(f"'{w}'" for w in sorted(set(fv.STOP_WORDS)))


def sql_stem(folded: str) -> str:
    cases = " ".join(f"WHEN length({folded}) >= {fv.MIN_STEM_CHARS + len(s)} AND suffix({folded}, '{s}') "
                     f"THEN left({folded}, length({folded}) - {len(s)})"
                     for s in fv.GERMAN_SUFFIXES + fv.ENGLISH_SUFFIXES)
    return f"CASE WHEN length({folded}) <= 4 THEN {folded} {cases} ELSE {folded} END"


def sql_terms(rows: str, keys: str) -> str:
    """One row per index term of the ``text`` of a relation (compounds apart, see explode_terms)."""
    return f"""(SELECT {keys}, term FROM (
      SELECT {keys}, unnest(list_distinct([tok, nf,
        replace(replace(replace(replace(tok, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss'), {sql_stem('nf')}])) AS form
      FROM (SELECT {keys}, tok, strip_accents(tok) AS nf FROM (
        SELECT {keys}, lower(unnest(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+'))) AS tok FROM {rows}) w
        WHERE length(tok) >= 2 AND tok NOT IN ({_STOP})) f) v,
      unnest(CASE WHEN contains(form, '_') THEN list_concat(list_filter(string_split(form, '_'), lambda p: p <> ''), [form])
             ELSE [form] END) AS u(term))"""


def sql_bm25(chunk_rows: str, query_rows: str, k: int, texts: str | None = None, extra: str = "") -> str:
    """CTEs ending in ``lex``: query_id, db, source, chunk_id, bm25, rank of the k best chunks."""
    return f"""chunk_rows AS ({chunk_rows}), query_rows AS ({query_rows}), texts AS ({texts or 'SELECT * FROM chunk_rows'}),
      terms AS {sql_terms('texts', 'db, scope, source, chunk_id')},
      tf AS (SELECT db, scope, source, chunk_id, term, count(*) AS tf FROM terms GROUP BY ALL),
      dl AS (SELECT db, scope, source, chunk_id, sum(CASE WHEN contains(term, '_') THEN 0 ELSE tf END) AS dl
             FROM tf GROUP BY ALL),
      corpus AS (SELECT c.db, c.n, l.total / c.n AS avgdl FROM (SELECT db, count(*) AS n FROM chunk_rows GROUP BY db) c
                 JOIN (SELECT db, CAST(sum(dl) AS DOUBLE) AS total FROM dl GROUP BY db) l USING (db)),
      dfs AS (SELECT db, term, count(*) AS df FROM tf GROUP BY ALL),
      asked AS (SELECT DISTINCT query_id, db, term FROM {sql_terms('query_rows', 'query_id, db')}),
      scored AS (SELECT a.query_id, t.db, t.scope, t.source, t.chunk_id,
          sum(greatest(ln((c.n - d.df + 0.5) / (d.df + 0.5)), 1e-6) * t.tf * 2.2
              / (t.tf + 1.2 * (0.25 + 0.75 * l.dl / c.avgdl))) AS bm25,
          string_agg(t.term, ',' ORDER BY t.term) AS matched_terms
        FROM tf t JOIN asked a ON a.db = t.db AND a.term = t.term JOIN dfs d ON d.db = t.db AND d.term = t.term
          JOIN corpus c ON c.db = t.db JOIN dl l ON l.db = t.db AND l.scope = t.scope AND l.source = t.source
             AND l.chunk_id = t.chunk_id {extra}
        GROUP BY ALL),
      lex AS (SELECT *, row_number() OVER (PARTITION BY query_id, db ORDER BY round(bm25, 6) DESC, chunk_id, source) - 1
              AS rank FROM scored QUALIFY rank < {k})"""


def sql_letters(text: str) -> str:
    counts = ", ".join(f"CAST(length(t) - length(replace(t, '{chr(c)}', '')) AS DOUBLE)" for c in range(97, 123))
    return f"list_transform([lower(left({text}, {fv.EMBED_CHARS}))], lambda t: [{counts}])[1]"


def sql_dense(k: int) -> str:
    """CTE ``sem`` over chunk_rows and query_rows with the letter model."""
    unit = "list_transform(v, lambda x: x / (CASE WHEN n = 0 THEN 1 ELSE n END))"
    return f"""cv AS (SELECT db, scope, source, chunk_id, {unit} AS vec FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
         FROM (SELECT *, {sql_letters('text')} AS v FROM chunk_rows))),
      qv AS (SELECT query_id, db, {unit} AS vec FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n
         FROM (SELECT *, {sql_letters('text')} AS v FROM query_rows))),
      sims AS (SELECT q.query_id, c.db, c.scope, c.source, c.chunk_id, list_inner_product(c.vec, q.vec) AS sim
         FROM cv c JOIN qv q USING (db)),
      sem AS (SELECT *, row_number() OVER (PARTITION BY query_id, db ORDER BY round(sim, 6) DESC, chunk_id, source) - 1
         AS rank FROM sims QUALIFY rank < {k})"""


def sql_contribution(rank: str) -> str:
    return f"(1.0::DOUBLE / (61 + {rank}) + CASE WHEN {rank} = 0 THEN 0.05 WHEN {rank} <= 2 THEN 0.02 ELSE 0 END)"


def sql_fused(k: int) -> str:
    """CTE ``fused`` over ``lex`` and ``sem``."""
    total = (f"coalesce({sql_contribution('l.rank')}, 0) + 2.0 * coalesce({sql_contribution('s.rank')}, 0)")
    return f"""both_arms AS (SELECT query_id, db, chunk_id, coalesce(l.source, s.source) AS source, l.matched_terms, {total} AS rrf
        FROM lex l FULL JOIN sem s USING (query_id, db, chunk_id)),
      fused AS (SELECT *, row_number() OVER (PARTITION BY query_id, db ORDER BY round(rrf, 12) DESC, chunk_id) - 1 AS rank
        FROM both_arms QUALIFY rank < {k})"""
