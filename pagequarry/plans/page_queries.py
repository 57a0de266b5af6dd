"""Pages, graph, resolution, rules, access, log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as dt
from pagequarry.functions import markup as mk
from pagequarry.functions import rules
from pagequarry.functions import text as tx
from pagequarry.functions import words as wd
from pagequarry.operators import access, graph, pages, resolve
from pagequarry.plans import inputs as src
from pagequarry.plans.search_queries import query as _query
from pagequarry.session import cut_lineage, spread, spread_read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    return _query(oracle, QUERIES, ORACLES)


def _strings():
    return F.array().cast("array<string>")


# --- graph: parts are pages, line items are links and sources --------------------------------------

def _parts(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "part").select(
        F.substring("p_brand", 1, 5).alias("db"), F.concat(F.lit("part-"), "p_partkey", F.lit(".md")).alias("filename"),
        F.col("p_name").alias("title"), F.col("p_name").alias("body"), F.lit("concept").alias("type"))


def _stated(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "lineitem").select(
        F.substring(F.concat(F.lit("Brand"), "l_returnflag"), 1, 5).alias("db"),
        F.concat(F.lit("part-"), "l_partkey", F.lit(".md")).alias("src"), F.col("l_linenumber").alias("pos"),
        F.concat(F.lit("part-"), "l_orderkey", F.lit(".md")).alias("dst"))


def _listed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources of part pages: one supplier on one day."""
    return src.table(spark, sf, "lineitem").select(
        F.substring(F.concat(F.lit("Brand"), "l_returnflag"), 1, 5).alias("db"),
        F.concat(F.lit("part-"), "l_partkey", F.lit(".md")).alias("filename"),
        F.concat_ws("-", "l_suppkey", F.date_format("l_shipdate", "yyyyMMdd")).alias("source"))


_STATED = "st AS (SELECT 'part-' || l_partkey || '.md' AS src, l_linenumber AS pos, 'part-' || l_orderkey || '.md' AS dst FROM lineitem)"
_PAGES = "pg AS (SELECT 'part-' || p_partkey || '.md' AS filename FROM part)"
_LINKS = f"{_STATED}, {_PAGES}, lk AS (SELECT DISTINCT src, dst FROM st WHERE src <> dst AND dst IN (SELECT filename FROM pg))"
_SIBS = """ls AS (SELECT 'part-' || l_partkey || '.md' AS filename, l_suppkey || '-' || strftime(l_shipdate, '%Y%m%d') AS source FROM lineitem),
  sm AS (SELECT source FROM ls GROUP BY source HAVING count(*) <= 8),
  sb AS (SELECT DISTINCT a.filename AS src, b.filename AS dst FROM ls a JOIN ls b USING (source) SEMI JOIN sm USING (source) WHERE a.filename <> b.filename)"""


@query(f"WITH {_LINKS} SELECT src, dst FROM lk")
def link_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct links between existing pages."""
    return graph.link_graph(_stated(spark, sf), _parts(spark, sf)).select("src", "dst")


@query(f"WITH {_LINKS} SELECT dst AS page, count(*) AS n, min(src) AS first FROM lk GROUP BY dst")
def backlinks(spark: SparkSession, sf: str) -> DataFrame:
    """Q7: pages that cite a page."""
    back = graph.backlinks(graph.link_graph(_stated(spark, sf), _parts(spark, sf)))
    return back.groupBy("page").agg(F.count("*").alias("n"), F.min("cited_by").alias("first"))


@query(f"WITH {_LINKS} SELECT filename FROM pg WHERE filename NOT IN (SELECT dst FROM lk)")
def orphans(spark: SparkSession, sf: str) -> DataFrame:
    """Pages nobody links to."""
    parts = _parts(spark, sf)
    return graph.orphans(parts, graph.link_graph(_stated(spark, sf), parts)).select("filename")


@query("""WITH ls AS (SELECT l_orderkey AS page, l_partkey || '-' || l_returnflag || '-' || l_linestatus AS source FROM lineitem),
  sm AS (SELECT source FROM ls GROUP BY source HAVING count(*) <= 8)
SELECT DISTINCT CAST(a.page AS VARCHAR) AS src, CAST(b.page AS VARCHAR) AS dst FROM ls a JOIN ls b USING (source) SEMI JOIN sm USING (source)
WHERE a.page <> b.page""")
def shared_source_siblings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that share a part; sources behind more than 8 pages are noise."""
    listed = src.table(spark, sf, "lineitem").select(
        F.col("l_linestatus").substr(1, 0).alias("db"), F.col("l_orderkey").cast("string").alias("filename"),
        F.concat_ws("-", "l_partkey", "l_returnflag", "l_linestatus").alias("source"))
    return graph.source_siblings(listed).select("src", "dst")


@query(f"""WITH {_LINKS}, {_SIBS},
 seeds AS (SELECT p_brand AS q, 'part-' || p_partkey || '.md' AS seed, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS ord
   FROM part QUALIFY ord <= 3),
 ed AS (SELECT src AS seed, dst AS cand, 0 AS way, pos FROM st UNION ALL SELECT dst, src, 1, 0 FROM lk UNION ALL SELECT src, dst, 2, 0 FROM sb),
 re AS (SELECT q, cand, way, pos, s.seed, ord FROM ed JOIN seeds s USING (seed) WHERE cand IN (SELECT filename FROM pg)
   AND (q, cand) NOT IN (SELECT (q, seed) FROM seeds)),
 ag AS (SELECT q, cand, count(*) FILTER (way < 2) AS n_links, count(*) FILTER (way = 2) AS n_shared, min((ord, way, pos, cand, seed)) AS f FROM re GROUP BY ALL)
SELECT q AS query_id, cand AS filename, f[5] AS via, CASE WHEN n_links > 0 THEN 'link' ELSE 'shared-source' END AS kind, n_links, n_shared,
 CAST(row_number() OVER (PARTITION BY q ORDER BY CASE WHEN n_links = 0 THEN 1 ELSE 0 END, n_links DESC, n_shared DESC, f) AS BIGINT) AS rank
FROM ag QUALIFY rank <= 5""")
def linked_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of the three dearest parts of every brand."""
    parts, stated, listed = _parts(spark, sf), _stated(spark, sf), _listed(spark, sf)
    ranked = pages.ranked_per(src.table(spark, sf, "part"), ["p_brand"], [F.desc("p_retailprice"), F.col("p_partkey")], fv.LINK_SEEDS)
    seeds = ranked.select(F.col("p_brand").alias("query_id"), F.substring("p_brand", 1, 5).alias("db"), F.col("rank").alias("ord"),
                          F.concat(F.lit("part-"), "p_partkey", F.lit(".md")).alias("filename"))
    found = graph.neighbours(seeds, parts, stated, graph.link_graph(stated, parts), graph.source_siblings(listed))
    return found.select("query_id", "filename", "via", "kind", "n_links", "n_shared", F.col("rank").cast("long").alias("rank"))


def _typed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per line item: its order links to part pages and lists its supplier as source."""
    o = src.table(spark, sf, "lineitem")
    return o.select(F.substring(F.concat(F.lit("Brand"), "l_returnflag"), 1, 5).alias("db"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("filename"),
                    F.concat(F.lit("Order "), "l_orderkey").alias("title"),
                    F.when(F.col("l_returnflag") == "A", "concept").when(F.col("l_returnflag") == "N", "entity").otherwise("source-summary").alias("type"),
                    F.array(F.concat(F.lit("supplier-"), "l_suppkey", F.lit(" [Teil 1/2]")), F.lit("chat")).alias("sources"),
                    _strings().alias("related"))


@query("""WITH p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS f, 'Order ' || l_orderkey AS title, l_returnflag AS t, 'supplier-' || l_suppkey AS s FROM lineitem)
SELECT f AS id, 'page' AS type, title AS label, count(*) OVER (PARTITION BY f) > 0 AS shown FROM p WHERE t IN ('A', 'N')
UNION ALL SELECT DISTINCT 'source::' || s, 'source', s, true FROM p""")
def typed_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: page and source nodes; generated sources are left out."""
    nodes, _ = graph.typed_graph(_typed_pages(spark, sf))
    return nodes.select("id", "type", "label", F.lit(True).alias("shown"))


@query("""WITH p AS (SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS f, l_returnflag AS t, 'supplier-' || l_suppkey AS s FROM lineitem)
SELECT DISTINCT f AS "from", 'source::' || s AS "to", 'derived-from' AS type FROM p WHERE t IN ('A', 'N')""")
def typed_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Q8: edges of topic pages; source summaries give none."""
    _, edges = graph.typed_graph(_typed_pages(spark, sf))
    return edges.select("from", "to", "type")


# --- resolution: parts by name, type and brand ---------------------------------------------------------

def _topics(spark: SparkSession, sf: str) -> DataFrame:
    p = src.table(spark, sf, "part")
    title = F.concat_ws(" ", "p_name", F.when(F.col("p_size") > 25, F.col("p_type")))
    return p.select(F.substring("p_brand", 1, 5).alias("db"), F.concat(F.lit("part-"), "p_partkey", F.lit(".md")).alias("filename"), title.alias("title"),
                    F.when(F.col("p_retailprice") > 950, "Concept").otherwise("entity").alias("type"),
                    F.array_union(F.split(F.lower(title), " "), F.array(F.lower("p_brand"))).alias("key_terms"))


def _sql_key(t: str) -> str:
    s = src.sql_stem(t)
    return f"""CASE WHEN ({s}) = {t} THEN CASE WHEN length({t}) >= 5 AND suffix({t}, 'es') THEN left({t}, length({t}) - 2)
      WHEN length({t}) >= 4 AND suffix({t}, 's') AND NOT suffix({t}, 'ss') THEN left({t}, length({t}) - 1) ELSE {t} END ELSE {s} END"""


_TOPICS = f"""tp AS (SELECT 'part-' || p_partkey || '.md' AS filename, CASE WHEN p_retailprice > 950 THEN 'concept' ELSE 'entity' END AS type,
   lower(concat_ws(' ', p_name, CASE WHEN p_size > 25 THEN p_type END)) AS title, lower(p_brand) AS brand FROM part),
 sg AS (SELECT filename, type, title, array_to_string(list_sort(list_distinct(list_transform(string_split(title, ' '), lambda t: {_sql_key('t')}))), ' ') AS tokens,
   array_to_string(list_sort(list_distinct(list_append(string_split(title, ' '), brand))), ' ') AS terms FROM tp),
 ds AS (SELECT type, tokens, terms, string_split(tokens, ' ') AS tk, string_split(terms, ' ') AS tm FROM (SELECT DISTINCT type, tokens, terms FROM sg)),
 nest AS (SELECT a.type, a.tokens AS l, a.terms AS lt, b.tokens AS r, b.terms AS rt FROM ds a JOIN ds b ON a.type = b.type AND a.tokens <> b.tokens
   AND (list_has_all(a.tk, b.tk) OR list_has_all(b.tk, a.tk))
   AND len(list_intersect(a.tm, b.tm)) / least(len(a.tm), len(b.tm)) >= 0.7)"""


@query(f"WITH {_TOPICS} SELECT filename, tokens FROM sg")
def topic_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Topic keys of every title."""
    return resolve.with_topic(_topics(spark, sf)).select("filename", F.array_join("tokens", " ").alias("tokens"))


@query(f"""WITH {_TOPICS},
 eq AS (SELECT a.filename, min(b.filename) AS f FROM sg a JOIN sg b ON a.type = b.type AND a.tokens = b.tokens AND a.filename <> b.filename GROUP BY 1),
 nr AS (SELECT a.filename, min(b.filename) AS f FROM sg a JOIN nest n ON n.type = a.type AND n.l = a.tokens AND n.lt = a.terms
   JOIN (SELECT type, tokens, terms, min(filename) AS filename FROM sg GROUP BY ALL) b ON b.type = n.type AND b.tokens = n.r AND b.terms = n.rt GROUP BY 1)
SELECT filename, coalesce(eq.f, nr.f) AS target FROM sg LEFT JOIN eq USING (filename) LEFT JOIN nr USING (filename)""")
def topic_route(spark: SparkSession, sf: str) -> DataFrame:
    """The page every part page would be merged into."""
    topics = _topics(spark, sf)
    return resolve.route(topics, topics).select("filename", "target")


@query(f"""WITH RECURSIVE {_TOPICS}, ed AS (SELECT DISTINCT type || '|' || l AS a, type || '|' || r AS b FROM nest),
 nd AS (SELECT DISTINCT type || '|' || tokens AS n FROM sg),
 rc AS (SELECT n, n AS c FROM nd UNION SELECT ed.b, rc.c FROM rc JOIN ed ON ed.a = rc.n),
 cc AS (SELECT n, min(c) AS c FROM rc GROUP BY n),
 gr AS (SELECT filename, c, len(string_split(tokens, ' ')) AS nt FROM sg JOIN cc ON cc.n = sg.type || '|' || sg.tokens),
 cn AS (SELECT c, min((nt, length(filename), filename)) AS m FROM gr GROUP BY c)
SELECT filename AS member, m[3] AS canonical FROM gr JOIN cn USING (c)""")
def merge_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Same-topic components and their leading page."""
    return resolve.merge_plan(resolve.topic_groups(_topics(spark, sf))).select("member", "canonical")


@query("""WITH m AS (SELECT n_regionkey, n_nationkey, n_name, min(n_nationkey) OVER (PARTITION BY n_regionkey) AS base FROM nation),
 c AS (SELECT l_partkey AS f, l_orderkey AS d FROM lineitem),
 t AS (SELECT DISTINCT f AS part, s_suppkey FROM (SELECT l_partkey AS f, l_suppkey AS s_suppkey FROM lineitem))
SELECT CAST(o_custkey AS VARCHAR) AS canonical, 'status ' || o_orderstatus AS line, min(o_orderkey) AS first FROM orders GROUP BY ALL
UNION ALL SELECT CAST(o_custkey AS VARCHAR), '## Notes', min(o_orderkey) FROM orders GROUP BY 1
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'priority ' || o_orderpriority, min(o_orderkey) FROM orders GROUP BY ALL""")
def merged_lines(spark: SparkSession, sf: str) -> DataFrame:
    """All orders of a customer as pages merged into one."""
    o = src.table(spark, sf, "orders")
    body = F.concat(F.lit("status "), "o_orderstatus", F.lit("\n\n## Notes\npriority "), "o_orderpriority")
    first = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("base"))
    members = o.join(first, "o_custkey").select(
        F.col("o_orderstatus").substr(1, 0).alias("db"), F.col("o_custkey").cast("string").alias("canonical"),
        F.when(F.col("o_orderkey") == F.col("base"), 0).otherwise(F.col("o_orderkey") + 1).alias("ord"), "o_orderkey", "base", body.alias("body"))
    return resolve.merged_lines(members.select("db", "canonical", "ord", "body")).join(
        members.where("ord = 0").select("db", "canonical", "base"), ["db", "canonical"]).select(
        "canonical", "line", F.when(F.col("ord") == 0, F.col("base")).otherwise(F.col("ord") - 1).alias("first"))


def _part_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every line item as a page of its part; ord by order and line."""
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus"]
    name = lambda head, key: F.concat(F.lit(head), F.col(key).cast("string"))
    # Dealt by the name of the page, as merging deals them, and made into pages afterwards.
    lines = src.table(spark, sf, "lineitem").select(name("part-", "l_partkey").alias("canonical"), *order) \
        .withColumn("turn", F.row_number().over(Window.partitionBy("canonical").orderBy(*order)) - 1)
    return lines.select(
        F.lit("parts").alias("db"), "canonical", F.col("turn").cast("long").alias("ord"),
        F.concat(F.lit("Shipped with weight "), F.col("l_quantity").cast("long"), F.lit(" kg by "), "l_linestatus", F.lit(", see tariff 7.")).alias("body"),
        F.array(name("supplier-", "l_suppkey"), F.lit(" all.md "), F.lit("")).alias("sources"),
        F.array(name("line ", "l_linenumber"), F.lower("l_returnflag")).alias("key_terms"),
        F.when(F.col("l_suppkey") % 5 == 0, F.date_add(F.to_date("l_shipdate"), 30)).alias("effective_date"),
        F.to_date("l_shipdate").alias("updated"), F.date_sub(F.to_date("l_shipdate"), F.col("l_suppkey").cast("int")).alias("created"))


_PARTS = """m AS (SELECT 'part-' || l_partkey AS canonical, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity, l_shipdate, l_returnflag, l_linestatus) - 1 AS ord,
   CAST(l_quantity AS BIGINT) || ' kg' AS v, CASE WHEN l_suppkey % 5 = 0 THEN CAST(l_shipdate AS DATE) + 30 END AS e, CAST(l_shipdate AS DATE) AS d,
   CAST(l_shipdate AS DATE) - CAST(l_suppkey AS INTEGER) AS c, 'supplier-' || l_suppkey AS s, 'line ' || l_linenumber AS t1, lower(l_returnflag) AS t2 FROM lineitem),
 f AS (SELECT canonical, v, min(ord) AS ord FROM m GROUP BY ALL)"""


@query(f"""WITH {_PARTS}, o AS (SELECT a.canonical, a.ord, a.v, string_agg(b.v, ', ' ORDER BY b.v) AS old FROM f a JOIN f b ON a.canonical = b.canonical AND b.ord < a.ord GROUP BY ALL)
SELECT o.canonical, o.ord, CASE WHEN coalesce(m.e, m.d) > CASE WHEN o.ord = 1 THEN coalesce(b.e, b.d) ELSE coalesce(b.e, DATE '1996-01-01') END
  THEN 'weight: now ' || o.v || ' per the newer source; previously ' || o.old ELSE 'weight: sources disagree — ' || o.old || ' vs ' || o.v || ' (unresolved)' END AS sentence
FROM o JOIN m ON m.canonical = o.canonical AND m.ord = o.ord JOIN m b ON b.canonical = o.canonical AND b.ord = 0""")
def merged_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """What each page contradicts when it is merged into the page of its part."""
    return resolve.merged_conflicts(_part_pages(spark, sf), F.lit("1996-01-01").cast("date")).select("canonical", "ord", "sentence")


@query(f"""WITH {_PARTS}, x AS (SELECT canonical, min(ord) AS o, 0 AS p, s AS v FROM m GROUP BY canonical, s UNION ALL SELECT DISTINCT canonical, 0, 1, 'all.md' FROM m),
 k AS (SELECT canonical, v, min((ord, p)) AS o FROM (SELECT canonical, ord, 0 AS p, t1 AS v FROM m UNION ALL SELECT canonical, ord, 1, t2 FROM m) GROUP BY ALL),
 low AS (SELECT canonical FROM f GROUP BY canonical HAVING count(*) > 1)
SELECT canonical, min(c) AS created, CASE WHEN count(*) > 1 THEN DATE '1996-01-01' END AS updated,
  (SELECT string_agg(v, ',' ORDER BY o, p) FROM x WHERE x.canonical = m.canonical) AS sources,
  (SELECT string_agg(v, ',' ORDER BY o) FROM k WHERE k.canonical = m.canonical) AS key_terms,
  CASE WHEN canonical IN (SELECT canonical FROM low) THEN 'low' END AS confidence FROM m GROUP BY canonical""")
def merged_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Lists united in order, earliest and new dates, low confidence after a conflict."""
    members, today = cut_lineage(_part_pages(spark, sf)), F.lit("1996-01-01").cast("date")
    # Line items are dealt once more for the conflicts: members that were written lie anyhow, and would meet through three exchanges.
    out = resolve.merged_header(members, resolve.merged_conflicts(_part_pages(spark, sf), today), today)
    return out.select("canonical", "created", "updated", F.array_join("sources", ",").alias("sources"),
                      F.array_join("key_terms", ",").alias("key_terms"), "confidence")


@query("""SELECT 'part-' || l_partkey || '.md' AS page, l_orderkey, l_linenumber, 'weight|kg' AS key,
  CASE WHEN l_shipdate > TIMESTAMP '1998-01-01' THEN 'weight: now ' || CAST(l_quantity AS BIGINT) || ' kg per the newer source; previously ' || p_size || ' kg'
  ELSE 'weight: sources disagree — ' || p_size || ' kg vs ' || CAST(l_quantity AS BIGINT) || ' kg (unresolved)' END AS sentence
FROM lineitem JOIN part ON p_partkey = l_partkey WHERE CAST(l_quantity AS BIGINT) <> p_size""")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of line items against the weight on the part page."""
    line, part = src.table(spark, sf, "lineitem"), src.table(spark, sf, "part")
    old = part.select(F.concat(F.lit("part-"), "p_partkey", F.lit(".md")).alias("page"), F.to_date(F.lit("1998-01-01")).alias("old_date"),
                      F.concat("p_name", F.lit(" has weight "), "p_size", F.lit(" kg and is kept 12 days.")).alias("old_text"))
    new = line.select(F.concat(F.lit("part-"), "l_partkey", F.lit(".md")).alias("page"), "l_orderkey", "l_linenumber",
                      F.concat(F.lit("Shipped with weight "), F.col("l_quantity").cast("long"), F.lit(" kg, see tariff 7.")).alias("new_text"),
                      F.to_date("l_shipdate").alias("new_date"))
    out = resolve.contradictions_between(old, new, ["page"])
    return out.select("page", "l_orderkey", "l_linenumber", "key", "sentence")


# --- pages ------------------------------------------------------------------------------------------------

def _doc_pages(spark: SparkSession, sf: str) -> DataFrame:
    """One page per document: type by language, its collection and its own file as sources."""
    d = src.table(spark, sf, "documents")
    return d.select(
        F.regexp_replace("source", "[0-9]+", "").alias("db"), F.concat(F.lit("page-"), "doc_id", F.lit(".md")).alias("filename"),
        F.concat(F.lit("Doc "), "doc_id").alias("title"),
        F.when(F.col("lang") == "en", "Concept").when(F.col("lang") == "de", "entity").when(F.col("lang") == "fr", "source-summary").otherwise("").alias("type"),
        F.array(F.concat("source", F.lit(".md")), F.concat(F.lit("doc-"), "doc_id", F.lit(".txt"))).alias("sources"),
        F.array(F.concat(F.lit("page-"), F.col("doc_id") + 1, F.lit(".md"))).alias("related"),
        F.lit(None).cast("string").alias("description"), F.col("source").alias("part_of"),
        F.to_date(F.lit("2024-01-01")).alias("created"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("n_chars").cast("int")).alias("updated"),
        F.when(F.col("lang") == "de", 30).cast("int").alias("expires_after_days"), (F.col("lang") == "es").alias("is_insight"), F.col("text").alias("body"))


_TYPE = "CASE lang WHEN 'en' THEN 'concept' WHEN 'de' THEN 'entity' WHEN 'fr' THEN 'source-summary' ELSE 'concept' END"


@query(f"""SELECT 'page-' || doc_id || '.md' AS filename, 'src,' || {_TYPE} || ',' || source AS tags,
 CASE WHEN lang = 'fr' THEN 'raw/' || source || '.md' END AS resource,
 strftime(DATE '2024-01-01' + CAST(n_chars AS INTEGER), '%Y-%m-%d') || 'T00:00:00Z' AS ts FROM documents""")
def stamped_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Derived tags, resource and timestamp."""
    out = pages.stamp(_doc_pages(spark, sf))
    return out.select("filename", F.array_join("tags", ",").alias("tags"), "resource", F.col("timestamp").alias("ts"))


@query("""WITH l AS (SELECT doc_id, lang, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')),
   lambda x: x <> '' AND NOT regexp_matches(x, '^[#\\-*|>]'))[1] AS line FROM documents),
 r AS (SELECT doc_id, CASE lang WHEN 'de' THEN 'Fact of ' || doc_id || ' [Source: a.md], short. ;' WHEN 'fr' THEN 'Stated' ELSE coalesce(nullif(regexp_extract(line, '^(.*?[.!?])\\s', 1), ''), line, '') END AS raw FROM l),
 c AS (SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(raw, '\\[[^\\]]*\\]', '', 'g'), '\\s+', ' ', 'g')), '^[ .;,]+', ''), '[ .;,]+$', '') AS clean FROM r)
SELECT doc_id, CASE WHEN length(clean) > 160 THEN rtrim(regexp_replace(left(clean, 160), ' [^ ]*$', '')) || '…' ELSE clean END AS description FROM c""")
def derived_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """a stated description stays; else the first key fact, else the first sentence, cut at a word."""
    facts = F.when(F.col("lang") == "de", F.concat(F.lit("\n## Key facts\n* Fact of "), "doc_id", F.lit(" [Source: a.md], short. ;\n- second\n"))).otherwise("")
    rows = src.table(spark, sf, "documents").select(
        "doc_id", F.lit("main").alias("db"), F.lit("concept").alias("type"), F.concat("text", facts).alias("body"), F.col("source").alias("part_of"),
        F.when(F.col("lang") == "fr", "Stated").otherwise(" ").alias("description"), F.array("source").alias("sources"),
        F.to_date(F.lit("2024-01-01")).alias("updated"), F.to_date(F.lit("2024-01-01")).alias("created"))
    return pages.stamp(spread(rows)).select("doc_id", "description")


@query("""SELECT 'page-' || doc_id || '.md' AS filename, rtrim(text, ' ' || chr(10) || chr(9) || chr(13)) || chr(10) || chr(10) || '## Citations' || chr(10) || chr(10)
 || '1. ' || source || '.md' || chr(10) || '2. doc-' || doc_id || '.txt' || chr(10) AS body FROM documents""")
def cited_pages(spark: SparkSession, sf: str) -> DataFrame:
    """citation sections, applied twice to show that the second time changes nothing."""
    once = _doc_pages(spark, sf).withColumn("body", mk.with_citations(F.col("body"), F.col("sources")))
    twice = spread(once).withColumn("body", mk.with_citations(F.col("body"), F.col("sources")))
    return twice.select("filename", "body")


@query("""SELECT 'page-' || doc_id || '.md' AS filename, 'Title ' || doc_id AS title, source || '.md,doc-' || doc_id || '.txt' AS sources,
 'page-' || (doc_id + 1) || '.md' AS related, CAST(n_chars AS BIGINT) AS ttl, DATE '2024-02-03' AS updated, lang AS mood,
 regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS body FROM documents""")
def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page files with a header, parsed; unknown keys are kept."""
    d = src.table(spark, sf, "documents")
    text = F.concat(F.lit('---\ntitle: "Title '), "doc_id", F.lit('"\ntype: concept\nsources: ['), "source", F.lit('.md, "doc-'), "doc_id",
                    F.lit('.txt"]\nrelated:\n- page-'), F.col("doc_id") + 1, F.lit(".md\nexpires_after_days: "), "n_chars",
                    F.lit('\nupdated: "2024-02-03"\nmood: '), "lang", F.lit("\n---\n\n"), "text")
    raw = spread(d.select(F.col("lang").alias("db"), F.concat(F.lit("page-"), "doc_id", F.lit(".md")).alias("filename"), F.lit(False).alias("is_insight"),
                          text.alias("text")))
    p = pages.parse_pages(raw)
    return p.select("filename", "title", F.array_join("sources", ",").alias("sources"), F.array_join("related", ",").alias("related"),
                    F.col("expires_after_days").cast("long").alias("ttl"), "updated", F.col("extra")["mood"].alias("mood"), "body")


@query("""SELECT CASE WHEN lang = 'es' THEN 'insights/' ELSE '' END || 'page-' || doc_id || '.md' AS filename,
 CAST(CASE WHEN lang = 'es' THEN 1 ELSE 0 END AS BIGINT) AS part, '* [Doc ' || doc_id || '](' || CASE WHEN lang = 'es' THEN 'insights/' ELSE '' END
 || 'page-' || doc_id || '.md) - ' || replace(left(text, 120), chr(10), ' ') AS line FROM documents""")
def index_page(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the index page."""
    return pages.index_lines(_doc_pages(spark, sf)).select("filename", F.col("part").cast("long").alias("part"), "line")


@query("""SELECT CASE WHEN lang = 'es' THEN 'insights/' ELSE '' END || 'page-' || doc_id || '.md' AS filename,
 CASE lang WHEN 'en' THEN 'concept' WHEN 'de' THEN 'entity' WHEN 'fr' THEN 'source-summary' ELSE 'insight' END AS "group",
 date_diff('day', DATE '2024-01-01' + CAST(n_chars AS INTEGER), DATE '2029-01-01') > CASE WHEN lang = 'de' THEN 30 ELSE 365 END AS stale FROM documents""")
def type_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Pages by type with their freshness on a fixed day."""
    return pages.tree(_doc_pages(spark, sf), F.to_date(F.lit("2029-01-01"))).select("filename", "group", "stale")


@query("SELECT 'page-' || doc_id || '.md: empty/missing required `type`' AS issue FROM documents WHERE lang = 'es' UNION ALL SELECT 'index.md: missing'")
def page_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Q22: pages without type, and no index page."""
    rows = _doc_pages(spark, sf)
    return pages.issues(rows, rows.where(F.lit(False)).select("db", F.lit("0.1").alias("format_version"))).select("issue")


@query("""WITH gone AS (SELECT source FROM documents GROUP BY source HAVING avg(n_chars) > 2500), hit AS (SELECT doc_id, lang, source,
  EXISTS (SELECT 1 FROM gone WHERE starts_with(documents.source || '.md', gone.source)) AS g FROM documents), rm AS (SELECT doc_id FROM hit WHERE g AND lang IN ('en', 'es'))
SELECT 'page-' || doc_id || '.md' AS filename, CASE WHEN g THEN '' ELSE source || '.md' END AS first, CASE WHEN doc_id + 1 IN (SELECT doc_id FROM rm) THEN 0 ELSE 1 END AS n_related
FROM hit WHERE doc_id NOT IN (SELECT doc_id FROM rm)""")
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Sources deleted with the pages that live on them alone, links scrubbed."""
    d = src.table(spark, sf, "documents")
    rows = _doc_pages(spark, sf).withColumn("sources", F.when(F.col("type").isin("Concept", ""), F.slice("sources", 1, 1)).otherwise(F.col("sources")))
    gone = d.groupBy("source").agg(F.avg("n_chars").alias("n")).where("n > 2500").select(
        F.regexp_replace("source", "[0-9]+", "").alias("db"), "source")
    left, _ = pages.cascade_delete(rows, gone, F.to_date(F.lit("2030-01-01")))
    first = F.coalesce(F.get(F.filter("sources", lambda s: s.startswith("src")), F.lit(0)), F.lit(""))
    return left.select("filename", first.alias("first"), F.size("related").alias("n_related"))


@query("""SELECT 'page-' || doc_id || '.md' AS filename, 'A' || chr(10) || CASE WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 21
  THEN '## key facts' || chr(10) || text ELSE '## Key facts' || chr(10) || 'x01234567890123456789' END || chr(10) || '## End' || chr(10) || source AS body, CAST(1 AS BIGINT) AS removed
 FROM (SELECT doc_id, source, regexp_replace(text, '(?m)^##', '.##', 'g') AS text FROM documents)""")
def section_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """Of two adjacent equal sections the longer one stays, of equally long ones the first."""
    d = spread_read(src.table(spark, sf, "documents").select("doc_id", "source", "text"), "doc_id", "source") \
        .withColumn("text", F.regexp_replace("text", "(?md)^##", ".##"))
    body = F.concat(F.lit("A\n## Key facts\nx01234567890123456789\n## key facts\n"), "text", F.lit("\n## End\n"), "source")
    rows = d.select(F.concat(F.lit("page-"), "doc_id", F.lit(".md")).alias("filename"), body.alias("b"))
    out = rows.withColumn("c", mk.collapse_sections(F.col("b")))
    return out.select("filename", F.col("c.body").alias("body"), F.col("c.removed").cast("long").alias("removed"))


# --- log, memory, rules, access -----------------------------------------------------------------------------

@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, '- ' || strftime(ts, '%H:%M') || ' — ' || event_type || ': user ' || user_id AS line, event_id FROM events""")
def log_by_day(spark: SparkSession, sf: str) -> DataFrame:
    """Activity log lines by day."""
    e = src.table(spark, sf, "events")
    log = e.select(F.col("event_type").substr(1, 0).alias("db"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("ts", "HH:mm").alias("time"),
                   F.col("event_id").alias("seq"), F.col("event_type").alias("action"), F.concat(F.lit("user \n "), "user_id").alias("detail"))
    return pages.log_view(log).select("day", "line", F.col("seq").alias("event_id"))


@query("SELECT user_id, event_type, min(event_id) AS first_step, count(*) - 1 AS repeats FROM events GROUP BY ALL")
def first_visits(spark: SparkSession, sf: str) -> DataFrame:
    """First step of every key of a run."""
    e = src.table(spark, sf, "events").withColumnRenamed("event_id", "step")
    return pages.first_visits(e, ["user_id", "event_type"])


_TREE = {"op": "and", "args": [
    {"op": "between", "fact": "l_quantity", "low": 10, "high": 40},
    {"op": "or", "args": [{"op": "in", "fact": "l_returnflag", "value": ["A", "R"]}, {"op": ">", "fact": "l_discount", "value": 0.05}]},
    {"op": "not", "arg": {"op": "==", "fact": "l_linestatus", "value": "F"}},
    {"op": "not", "arg": {"op": ">", "fact": "no_such_fact", "value": 3}},
    {"op": "not", "arg": {"op": "<", "fact": "l_returnflag", "value": 3}},
    {"op": "contains", "fact": "l_orderkey", "value": 1}, {"op": "!=", "fact": "l_tax", "value": 0.04}]}


@query("""SELECT l_orderkey, l_linenumber, l_partkey, (l_quantity BETWEEN 10 AND 40 AND (l_returnflag IN ('A', 'R') OR l_discount > 0.05) AND l_linestatus <> 'F'
  AND contains(CAST(l_orderkey AS VARCHAR), '1') AND l_tax <> 0.04) AS passed FROM lineitem""")
def condition_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A nested condition over every line item."""
    rows = src.table(spark, sf, "lineitem")
    return rules.evaluate(rows, _TREE).select("l_orderkey", "l_linenumber", "l_partkey", "passed")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', l_quantity BETWEEN 10 AND 40, l_returnflag IN ('A', 'R'), l_discount > 0.05,
  l_returnflag IN ('A', 'R') OR l_discount > 0.05, l_linestatus = 'F', l_linestatus <> 'F', false, true, false, true, contains(CAST(l_orderkey AS VARCHAR), '1'),
  l_tax <> 0.04, (l_quantity BETWEEN 10 AND 40 AND (l_returnflag IN ('A', 'R') OR l_discount > 0.05) AND l_linestatus <> 'F'
  AND contains(CAST(l_orderkey AS VARCHAR), '1') AND l_tax <> 0.04)) AS trace FROM lineitem""")
def condition_trace(spark: SparkSession, sf: str) -> DataFrame:
    """The result of every node, no short circuit, missing facts false."""
    out = rules.evaluate(src.table(spark, sf, "lineitem"), _TREE, with_trace=True)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(F.transform("trace", lambda b: b.cast("string")), ",").alias("trace"))


@query("""WITH c AS (SELECT conv_id, turn, text || ' [Source: a.md §1] [Source: b.txt] [Wiki: ' || role || '.md]' AS t FROM conversations),
 n AS (SELECT *, len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS w FROM c)
SELECT conv_id, turn, CASE WHEN w < 300 THEN 'REJECTED: words' ELSE 'ACCEPTED: ' || w || ' words, 3 sources cited.' END AS verdict FROM n""")
def citation_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Chat turns with citations against the gate."""
    c = src.table(spark, sf, "conversations")
    t = F.concat("text", F.lit(" [Source: a.md §1] [Source: b.txt] [Wiki: "), "role", F.lit(".md]"))
    return c.select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", tx.chat_gate(F.col("t")).alias("verdict"))


@query("""WITH c AS (SELECT doc_id, text || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' [Wiki: a.md] [Wiki:  b.md ]' WHEN 2 THEN ' [Source: a.md] [Source: a.md ]'
   WHEN 3 THEN ' [Source: a.md §1] [Source: a.md §2] [Wiki: a.md]' ELSE ' [Source: ' || source || '.txt] [Wiki: ' || lang || '.md] [Source: note.pdf]' END AS t FROM documents),
 n AS (SELECT doc_id, CAST(len(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS INTEGER) AS n_words,
   CAST([0, 0, 1, 2, 1][doc_id % 5 + 1] AS INTEGER) AS n_originals, CAST([0, 2, 1, 3, 2][doc_id % 5 + 1] AS INTEGER) AS n_sources FROM c)
SELECT *, CASE WHEN n_words < 300 THEN 'REJECTED: words' WHEN n_sources < 2 OR n_originals = 0 THEN 'REJECTED: sources'
  ELSE 'ACCEPTED: ' || n_words || ' words, ' || n_sources || ' sources cited.' END AS verdict FROM n""")
def citation_gate_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all lengths with no, repeated, wiki-only and section citations."""
    n = F.col("doc_id") % 5
    cited = (F.when(n == 0, "").when(n == 1, " [Wiki: a.md] [Wiki:  b.md ]").when(n == 2, " [Source: a.md] [Source: a.md ]")
             .when(n == 3, " [Source: a.md §1] [Source: a.md §2] [Wiki: a.md]")
             .otherwise(F.concat(F.lit(" [Source: "), "source", F.lit(".txt] [Wiki: "), "lang", F.lit(".md] [Source: note.pdf]"))))
    rows = src.table(spark, sf, "documents").select("doc_id", F.concat("text", cited).alias("t"))
    return rows.select("doc_id", *tx.chat_counts(F.col("t")), tx.chat_gate(F.col("t")).alias("verdict"))


_USERS = """u AS (SELECT c_name AS username, ['nation-' || c_nationkey, 'seg-' || lower(c_mktsegment)] AS dbs, c_acctbal > 5000 AS is_admin FROM customer)"""


@query(f"""WITH {_USERS} SELECT username, db, list_contains(dbs, db) OR (is_admin AND db = 'nation-3') AS reads,
  CASE WHEN is_admin THEN list_contains(dbs, db) OR db = 'nation-3' ELSE false END AS maintains, is_admin FROM u, (SELECT 'nation-' || n_nationkey AS db FROM nation)""")
def access_check(spark: SparkSession, sf: str) -> DataFrame:
    """Admins are back-filled as maintainers, granted one more database, then all users are checked."""
    users = src.table(spark, sf, "customer").select(
        F.col("c_name").alias("username"), F.array(F.concat(F.lit("nation-"), "c_nationkey"), F.concat(F.lit("seg-"), F.lower("c_mktsegment"))).alias("dbs"),
        F.lit(None).cast("array<string>").alias("maintains"), (F.col("c_acctbal") > 5000).alias("is_admin"))
    users = access.backfill_maintainers(users)
    grants = users.where("is_admin").select("username", F.lit("nation-3").alias("db"))
    users = access.grant_maintainer(users, grants)
    dbs = src.table(spark, sf, "nation").agg(F.collect_list(F.concat(F.lit("nation-"), "n_nationkey")).alias("dbs"))
    asked = users.select("username", F.lit(1).alias("one")).join(dbs.withColumn("one", F.lit(1)), "one") \
        .select("username", F.explode("dbs").alias("db"))
    return access.may_read(users, asked)


@query("""SELECT lang AS db, count(*) AS pages, count(*) AS raw_files, CAST(2 * sum(strlen(text)) AS BIGINT) AS data_bytes FROM documents GROUP BY lang""")
def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Pages, raw files and bytes per database."""
    d = src.table(spark, sf, "documents").select(F.col("lang").alias("db"), F.concat(F.lit("page-"), "doc_id").alias("filename"), F.col("text").alias("body"))
    return pages.stats(d, d.withColumnRenamed("body", "text"))
