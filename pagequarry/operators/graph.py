"""The page graph: links, back-links, shared sources, neighbours, typed view, orphans.

``pages``: db, filename, title, type, sources, related and more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx
from pagequarry.session import bounded_broadcast


def stated_links(pages: DataFrame) -> DataFrame:
    """db, src, pos, dst: every entry of every ``related`` list, as written."""
    return (pages.select("db", F.col("filename").alias("src"), F.posexplode("related").alias("pos", "dst"))
            .withColumn("dst", tx.strip(F.col("dst"))).where("dst <> ''"))


def link_graph(stated: DataFrame, pages: DataFrame) -> DataFrame:
    """db, src, dst: distinct links to other existing pages."""
    clean = stated.where((F.col("src") != F.col("dst")) & ~F.col("dst").isin(*fv.SYSTEM_PAGES)) \
        .select("db", "src", "dst").distinct()
    known = pages.select("db", F.col("filename").alias("dst"))
    return clean.join(known, ["db", "dst"], "left_semi").select("db", "src", "dst")


def backlinks(links: DataFrame) -> DataFrame:
    return links.select("db", F.col("dst").alias("page"), F.col("src").alias("cited_by"))


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """Pages no other page links to."""
    return (pages.select("db", "filename").where(~F.col("filename").isin(*fv.SYSTEM_PAGES))
            .join(links.select("db", F.col("dst").alias("filename")), ["db", "filename"], "left_anti"))


def page_sources(pages: DataFrame) -> DataFrame:
    """db, filename, source: one row per listed source."""
    return (pages.select("db", "filename", F.explode("sources").alias("source"))
            .withColumn("source", tx.strip(F.col("source"))).where("source <> ''"))


def source_siblings(listed: DataFrame, most: int = fv.SHARED_SOURCE_MAX_PAGES) -> DataFrame:
    """db, src, dst: pages with a common source, for sources of at most ``most`` pages.

    Sources are counted first, with map-side partial counts; a source behind a third of all
    pages is dropped before anything is paired, and no source pairs more than 8 by 8 rows.
    """
    small = listed.groupBy("db", "source").agg(F.count("*").alias("n")).where(F.col("n") <= most).drop("n")
    kept = listed.join(small, ["db", "source"])
    other = kept.withColumnRenamed("filename", "dst")
    return (kept.withColumnRenamed("filename", "src").join(other, ["db", "source"])
            .where("src <> dst").select("db", "src", "dst").distinct())


def neighbours(seeds: DataFrame, pages: DataFrame, stated: DataFrame, links: DataFrame, siblings: DataFrame,
               limit: int = fv.TOOL_LINK_NEIGHBOURS) -> DataFrame:
    """One hop from the seed pages of every query, best ``limit`` pages per query.

    ``seeds``: query_id, db, ord, filename.  Explicit links in either direction come before
    pages that only share a source; then the number of links, the number of shared sources,
    and the order of first discovery.
    """
    asked = bounded_broadcast(seeds.select("query_id", "db", "ord", F.col("filename").alias("seed")))
    edges = (stated.select("db", F.col("src").alias("seed"), F.col("dst").alias("filename"),
                           F.lit(0).alias("way"), "pos")
             .unionByName(links.select("db", F.col("dst").alias("seed"), F.col("src").alias("filename"),
                                       F.lit(1).alias("way"), F.lit(0).alias("pos")))
             .unionByName(siblings.select("db", F.col("src").alias("seed"), F.col("dst").alias("filename"),
                                          F.lit(2).alias("way"), F.lit(0).alias("pos"))))
    reached = (edges.join(asked, ["db", "seed"])
               .join(bounded_broadcast(seeds.select("query_id", "db", "filename")),
                     ["query_id", "db", "filename"], "left_anti")
               .join(pages.select("db", "filename"), ["db", "filename"], "left_semi"))
    found = reached.groupBy("query_id", "db", "filename").agg(
        F.count(F.when(F.col("way") < 2, 1)).alias("n_links"),
        F.count(F.when(F.col("way") == 2, 1)).alias("n_shared"),
        F.min(F.struct("ord", "way", "pos", "filename", "seed")).alias("first"))
    order = W.partitionBy("query_id", "db").orderBy(
        (F.col("n_links") == 0).cast("int"), F.desc("n_links"), F.desc("n_shared"), "first")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
            .select("query_id", "db", "rank", "filename", F.col("first.seed").alias("via"),
                    F.when(F.col("n_links") > 0, "link").otherwise("shared-source").alias("kind"),
                    "n_links", "n_shared"))


def with_excerpt(found: DataFrame, pages: DataFrame, n_chars: int = 240) -> DataFrame:
    """Title and the first characters of the body of found pages."""
    texts = pages.select("db", "filename", F.coalesce("title", "filename").alias("title"),
                         F.left(F.trim(tx.squeeze(F.col("body"))), F.lit(n_chars)).alias("excerpt"))
    return found.join(texts, ["db", "filename"])


_PART_SUFFIX = r"\s*\[Teil\s+\d+/\d+\]\s*(?:\.md)?\s*$"
_GENERATED = r"\A(?:summary|concept|entity)-"


def typed_graph(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: db, id, type, label; edges: db, from, to, type)."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit("other"))))
    topic = pages.where(kind.isin("concept", "entity"))
    shown = pages.where(kind.isin("concept", "entity", "source-summary"))

    links = link_graph(stated_links(topic), pages)
    pair = links.select("db", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "src", "dst")
    related = (pair.groupBy("db", "a", "b").agg(F.min(F.struct("src", "dst")).alias("e"))
               .select("db", F.col("e.src").alias("from"), F.col("e.dst").alias("to"), F.lit("related-to").alias("type")))

    def originals(rows: DataFrame) -> DataFrame:
        raw = tx.strip(F.regexp_replace("source", _PART_SUFFIX, ""))
        return (page_sources(rows).withColumn("source", raw)
                .where((F.col("source") != "") & (F.col("source") != "chat") & ~F.col("source").rlike(_GENERATED)))

    derived = (originals(topic).select("db", F.col("filename").alias("from"),
                                       F.concat(F.lit("source::"), "source").alias("to"),
                                       F.lit("derived-from").alias("type")).distinct())
    nodes = (topic.select("db", F.col("filename").alias("id"), F.lit("page").alias("type"),
                          F.coalesce("title", tx.file_stem(F.col("filename"))).alias("label"))
             .unionByName(originals(shown).select("db", F.concat(F.lit("source::"), "source").alias("id"),
                                                  F.lit("source").alias("type"), F.col("source").alias("label"))
                          .distinct()))
    return nodes, related.unionByName(derived)
