"""Page ingest, routing and consolidation over pages made of the documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import consolidate, ingest
from pagequarry.plans import inputs as src
from pagequarry.plans.search_queries import query as _query
from pagequarry.session import shared_folder
from pagequarry.sources.snapshots import SnapshotTable

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    return _query(oracle, QUERIES, ORACLES)


def _day(text: str):
    return F.to_date(F.lit(text))


def page_row(filename, title, kind, sources, related, body) -> list:
    """The columns of a stored page."""
    none = F.lit(None)
    return [F.lit("main").alias("db"), filename.alias("filename"), F.lit(False).alias("is_insight"), title.alias("title"), kind.alias("type"),
            sources.alias("sources"), related.alias("related"), F.array().cast("array<string>").alias("key_terms"),
            _day("2024-01-01").alias("created"), _day("2024-01-01").alias("updated"), none.cast("date").alias("effective_date"),
            none.cast("int").alias("expires_after_days"), none.cast("string").alias("description"), none.cast("string").alias("part_of"),
            F.lit("medium").alias("confidence"), body.alias("body")]


def _text(*parts):
    return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])


def _collection_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One stored page per collection of documents."""
    s = src.table(spark, sf, "documents").select("source").distinct()
    return s.select(*page_row(_text("concept-", F.col("source"), ".md"), _text("Topic ", F.col("source")), F.lit("concept"),
                              F.array(F.lit("first.md")), F.array().cast("array<string>"),
                              _text("## Key facts\n- Topic ", F.col("source"), "\n\n## Overview\nbase of ", F.col("source"))))


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """A model answer per document: a page on its collection, or a summary and a page without header, or nothing."""
    d, i, s = src.table(spark, sf, "documents"), F.col("doc_id"), F.col("source")
    topic = _text("Here it is.\n=== note-", i, ".md ===\n---\ntitle: Topic ", s, "\ntype: concept\nrelated: [concept-", s, ".md, nowhere.md]\n---\n## Overview\nseen ", i,
                  "\n\n## Details\nlength ", F.col("n_chars"), "\n=== END ===\n")
    parts = _text("=== summary-any.md ===\n---\ntitle: Doc ", i, "\ntype: source-summary\n---\nSummary of ", i, "\n=== END ===\n=== loose-", i,
                  ".md ===\nJust text ", i, "\n=== END ===")
    return d.select(F.lit("main").alias("db"), i.cast("bigint").alias("ord"), _text("doc-", i, ".txt").alias("source"),
                    F.when(F.col("lang").isin("en", "de"), topic).when(F.col("lang") == "fr", parts).otherwise("no pages today").alias("answer"))


@query("""WITH d AS (SELECT * FROM documents WHERE lang IN ('en', 'de')), n AS (SELECT source, count(*) AS n FROM d GROUP BY source),
 seen AS (SELECT source, string_agg('seen ' || doc_id, chr(10) ORDER BY doc_id) AS t,
   string_agg((doc_id_nr + 1) || '. doc-' || doc_id || '.txt', chr(10) ORDER BY doc_id) AS c, string_agg('doc-' || doc_id || '.txt', ',' ORDER BY doc_id) AS s
   FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS doc_id_nr FROM d) GROUP BY source),
 len AS (SELECT source, string_agg('length ' || n_chars, chr(10) ORDER BY first) AS t FROM (SELECT source, n_chars, min(doc_id) AS first FROM d GROUP BY ALL) GROUP BY source),
 base AS (SELECT DISTINCT source FROM documents)
SELECT 'concept-' || source || '.md' AS filename, coalesce(CASE WHEN n.n > 0 THEN 'updated' END, 'kept') AS status, coalesce(n.n, 0) AS n_pages, 'Topic ' || source AS title,
  concat_ws(',', 'first.md', s) AS sources, CASE WHEN n.n > 0 THEN 'concept-' || source || '.md' ELSE '' END AS related,
  CASE WHEN n.n > 0 THEN DATE '2024-06-01' ELSE DATE '2024-01-01' END AS updated,
  '## Key facts' || chr(10) || '- Topic ' || source || chr(10) || chr(10) || CASE WHEN n.n > 0 THEN '- Overview' || chr(10) || '- Details' || chr(10) ELSE '' END
  || '## Overview' || chr(10) || 'base of ' || source || CASE WHEN n.n > 0 THEN chr(10) || seen.t || chr(10) || '## Details' || chr(10) || len.t
  || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '1. first.md' || chr(10) || c || chr(10) ELSE '' END AS body
FROM base LEFT JOIN n USING (source) LEFT JOIN seen USING (source) LEFT JOIN len USING (source)
UNION ALL SELECT 'summary-doc-' || doc_id || '.md', 'created', 1, 'Doc ' || doc_id, 'doc-' || doc_id || '.txt', '', DATE '2024-06-01',
  '## Key facts' || chr(10) || '- Doc ' || doc_id || chr(10) || chr(10) || 'Summary of ' || doc_id || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '1. doc-' || doc_id || '.txt' || chr(10)
FROM documents WHERE lang = 'fr'
UNION ALL SELECT 'loose-' || doc_id || '.md', 'created', 1, 'Loose ' || doc_id, 'doc-' || doc_id || '.txt', '', DATE '2024-06-01',
  '## Key facts' || chr(10) || '- Loose ' || doc_id || chr(10) || chr(10) || 'Just text ' || doc_id || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || '1. doc-' || doc_id || '.txt' || chr(10)
FROM documents WHERE lang = 'fr'""")
def ingested_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Answers become pages, are routed, merged or created, stamped and switched in as one snapshot."""
    store = SnapshotTable(spark, f"{shared_folder(spark)}/pages-{uuid.uuid4().hex}", ("db", "filename"), buckets=8)
    store.write(_collection_pages(spark, sf))
    written, outcome = ingest.ingest(store.read(), _answers(spark, sf), _day("2024-06-01"))
    repeated = lambda rows: rows.groupBy("db", "filename").count().where("count > 1")
    store.merge(written, check=repeated)
    return store.read().join(outcome, ["db", "filename"], "left").select(
        "filename", F.coalesce("status", F.lit("kept")).alias("status"), F.coalesce("n_pages", F.lit(0)).cast("long").alias("n_pages"), "title",
        F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"), "updated", "body")


@query()
def routed_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: parts as a batch of pages of which earlier ones become targets of later ones, against the pages of their brands."""
    p = src.table(spark, sf, "part")
    words = F.split(F.lower("p_name"), " ")
    terms = F.array_distinct(F.concat(words, F.array(F.lower("p_brand"))))
    batch = p.select(F.substring("p_brand", 1, 5).alias("db"), F.col("p_partkey").cast("bigint").alias("ord"), F.concat(F.lit("part-"), "p_partkey", F.lit(".md")).alias("filename"),
                     F.col("p_name").alias("title"), F.when(F.col("p_retailprice") > 950, "concept").otherwise("entity").alias("type"), terms.alias("terms"),
                     F.slice(terms, 1, 2).alias("facts"), F.lit(None).cast("string").alias("fixed"))
    known = p.groupBy(F.get(words, F.lit(0)).alias("w"), F.substring("p_brand", 1, 5).alias("db")).agg(F.min("p_type").alias("t")).select(
        "db", F.concat(F.lit("word-"), "w", F.lit(".md")).alias("filename"), F.col("w").alias("title"), F.lit("concept").alias("type"),
        F.array("w", F.lower("t")).alias("key_terms"))
    return ingest.route_batch(batch, known).select("ord", "filename", "target")


def _scattered_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of one topic per collection, summaries in parts, and others, each linking to the next document's page."""
    d, i, s = src.table(spark, sf, "documents").select("doc_id", "lang", "source"), F.col("doc_id"), F.col("source")
    name = (F.when(F.col("lang").isin("en", "de"), _text("concept-", s, "-", i, ".md"))
            .when(F.col("lang") == "fr", _text("summary-", s, "-teil-", i, "-9.md")).otherwise(_text("page-", i, ".md")))
    named = d.withColumn("name", name)
    after = named.select((i - 1).alias("doc_id"), F.col("name").alias("after"))
    rows = named.join(after, "doc_id", "left")
    title = F.when(F.col("lang").isin("en", "de"), _text("Topic ", s)).when(F.col("lang") == "fr", _text("Doc ", s, " [Teil ", i, "/9]")).otherwise(_text("Page ", i))
    kind = F.when(F.col("lang") == "en", "concept").when(F.col("lang") == "de", "entity").when(F.col("lang") == "fr", "source-summary").otherwise("other")
    body = (F.when(F.col("lang").isin("en", "de"), _text("## Notes\nnote ", i, "\nshared line of ", s))
            .when(F.col("lang") == "fr", _text("Part ", i, " ", F.repeat(F.lit("x"), (i % 50).cast("int"))))
            .when(i % 2 == 0, "cite [x.md [Teil 1/2].md]").otherwise("plain"))
    listed = F.when(F.col("lang") == "fr", _text("doc-", s, ".txt [Teil ", i, "/9]")).otherwise(_text("doc-", i, ".txt"))
    related = F.filter(F.array(F.col("after"), F.lit("other.md")), lambda r: r.isNotNull())
    return rows.select(*page_row(F.col("name"), title, kind, F.array(listed), related, body))


_PAGES = """d AS (SELECT doc_id AS i, lang, source AS s, CASE WHEN lang IN ('en', 'de') THEN 'concept-' || source || '-' || doc_id || '.md'
    WHEN lang = 'fr' THEN 'summary-' || source || '-teil-' || doc_id || '-9.md' ELSE 'page-' || doc_id || '.md' END AS name FROM documents),
 p AS (SELECT d.*, e.name AS after FROM d LEFT JOIN d e ON e.i = d.i + 1),
 c AS (SELECT lang, s, min((length(name), name))[2] AS canonical, count(*) AS n FROM d WHERE lang IN ('en', 'de') GROUP BY ALL),
 f AS (SELECT s, 'summary-' || s || '.md' AS canonical, max((strlen('Part ' || i || ' ' || repeat('x', i % 50)), name))[2] AS base, count(*) AS n FROM d WHERE lang = 'fr' GROUP BY s),
 m AS (SELECT p.*, c.canonical, c.canonical AS base, c.n FROM p JOIN c ON c.lang = p.lang AND c.s = p.s UNION ALL SELECT p.*, f.canonical, f.base, f.n FROM p JOIN f ON f.s = p.s WHERE lang = 'fr'
   UNION ALL SELECT p.*, name, name, 1 FROM p WHERE lang NOT IN ('en', 'de', 'fr')),
 ren AS (SELECT name, canonical FROM m),
 o AS (SELECT *, CASE WHEN name = base THEN '' ELSE name END AS o FROM m),
 l AS (SELECT o.canonical, coalesce(ren.canonical, t) AS t, min((o, pos)) AS place FROM (SELECT canonical, o, unnest([after, 'other.md']) AS t, unnest([1, 2]) AS pos FROM o) o
   LEFT JOIN ren ON ren.name = t WHERE t IS NOT NULL AND coalesce(ren.canonical, t) <> o.canonical GROUP BY ALL),
 rel AS (SELECT canonical, string_agg(t, ',' ORDER BY place) AS related FROM l GROUP BY canonical),
 g AS (SELECT canonical, any_value(lang) AS lang, any_value(s) AS s, any_value(n) AS n, min_by(i, o) AS first, string_agg('note ' || i, chr(10) ORDER BY o) FILTER (o <> '') AS notes,
   string_agg(trim('Part ' || i || ' ' || repeat('x', i % 50)), chr(10) ORDER BY o) AS parts, string_agg('doc-' || i || '.txt', ',' ORDER BY o) AS sources,
   string_agg(nr || '. doc-' || i || '.txt', chr(10) ORDER BY nr) AS cites, string_agg(nr || '. doc-' || s || '.txt', chr(10) ORDER BY nr) AS part_cites
   FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY o) AS nr FROM o) GROUP BY canonical)"""


@query(f"""WITH {_PAGES} SELECT canonical AS filename,
  CASE WHEN lang IN ('en', 'de') THEN 'Topic ' || s WHEN lang = 'fr' THEN 'Doc ' || s ELSE 'Page ' || first END AS title,
  CASE WHEN lang = 'fr' THEN 'doc-' || s || '.txt' ELSE sources END AS sources, coalesce(related, '') AS related,
  CASE WHEN lang IN ('en', 'de') AND n = 1 THEN '## Notes' || chr(10) || 'note ' || first || chr(10) || 'shared line of ' || s
    WHEN lang IN ('en', 'de') THEN '## Key facts' || chr(10) || '- Topic ' || s || chr(10) || '- Notes' || chr(10) || chr(10) || '## Notes' || chr(10) || 'note ' || first || chr(10)
      || 'shared line of ' || s || chr(10) || notes || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || cites
    WHEN lang = 'fr' THEN '## Key facts' || chr(10) || '- Doc ' || s || chr(10) || chr(10) || parts
      || CASE WHEN n > 1 THEN chr(10) || chr(10) || '## Citations' || chr(10) || chr(10) || part_cites ELSE '' END
    WHEN first % 2 = 0 THEN '## Key facts' || chr(10) || '- Page ' || first || chr(10) || chr(10) || 'cite [x.md]' ELSE 'plain' END AS body
FROM g LEFT JOIN rel USING (canonical)""")
def consolidated_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Topic and summary groups merged, part markers cleaned, links re-pointed."""
    after, _ = consolidate.consolidate(_scattered_pages(spark, sf), _day("2024-06-01"))
    lines = F.transform(F.split("body", "\n"), lambda s: F.regexp_replace(s, " +$", ""))
    return after.select("filename", "title", F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"),
                        F.regexp_replace(F.array_join(lines, "\n"), r"\n+\z", "").alias("body"))
