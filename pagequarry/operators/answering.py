"""Composite page queries: page search, affected pages, candidates, context for an answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx
from pagequarry.operators import graph, lexical


def search_pages(page_chunks: DataFrame, pages: DataFrame, queries: DataFrame, k: int = fv.PAGE_SEARCH_HITS) -> DataFrame:
    """One row per page and query: its best chunk among the first ``k`` hits."""
    hits = lexical.search(page_chunks, queries, k)
    best = W.partitionBy("query_id", "db", "source").orderBy("rank")
    one = hits.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")
    titles = pages.select("db", F.col("filename").alias("source"), "title")
    shown = lexical.present(lexical.with_text(one, page_chunks)).join(titles, ["db", "source"], "left")
    return shown.select("query_id", "db", "rank", F.col("source").alias("filename"),
                        F.coalesce("title", F.replace("source", F.lit(".md"), F.lit(""))).alias("title"),
                        F.col("preview").alias("excerpt"), "score", "matched_terms")


def affected_pages(hits: DataFrame, pages: DataFrame, exclude: str | None = None) -> DataFrame:
    """Pages behind raw hits, ranked by the sum of their rounded scores; five per query."""
    listed = graph.page_sources(pages)
    kept = hits if exclude is None else hits.where(F.col("source") != F.col(exclude))
    summed = kept.join(listed, ["db", "source"]).groupBy("query_id", "db", "filename").agg(F.sum("score").alias("total"))
    order = W.partitionBy("query_id", "db").orderBy(F.round("total", 6).desc(), "filename")
    return summed.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < fv.AFFECTED_PAGES)


def candidate_pages(page_hits: DataFrame, raw_hits: DataFrame, pages: DataFrame) -> DataFrame:
    """At most ten pages per query: page hits in order, then pages behind raw hits."""
    known = pages.where(~F.col("filename").isin(*fv.SYSTEM_PAGES)).select("db", "filename")
    direct = page_hits.select("query_id", "db", F.lit(0).alias("arm"), "rank", F.col("source").alias("filename")) \
        .join(known, ["db", "filename"], "left_semi")
    behind = raw_hits.select("query_id", "db", F.lit(1).alias("arm"), "rank", "source") \
        .join(graph.page_sources(pages), ["db", "source"]).drop("source")
    first = direct.unionByName(behind).groupBy("query_id", "db", "filename").agg(F.min(F.struct("arm", "rank")).alias("at"))
    order = W.partitionBy("query_id", "db").orderBy("at", "filename")
    return (first.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < fv.CANDIDATE_PAGES)
            .select("query_id", "db", "ord", "filename"))


def expanded_candidates(candidates: DataFrame, pages: DataFrame, stated: DataFrame, links: DataFrame,
                        siblings: DataFrame) -> DataFrame:
    """Candidates followed by up to three neighbours of the first three."""
    seeds = candidates.where(F.col("ord") < fv.LINK_SEEDS)
    near = graph.neighbours(seeds, pages, stated, links, siblings, fv.LINK_NEIGHBOURS)
    fresh = near.join(candidates.select("query_id", "db", "filename"), ["query_id", "db", "filename"], "left_anti")
    return candidates.unionByName(fresh.select("query_id", "db", (F.col("rank") + fv.CANDIDATE_PAGES - 1).alias("ord"), "filename"))


def selected_pages(candidates: DataFrame, chosen: DataFrame | None = None) -> DataFrame:
    """The five pages to answer from: a model's choice among the candidates, else the first five."""
    if chosen is None:
        return candidates.where(F.col("ord") < fv.ANSWER_PAGES)
    valid = chosen.join(candidates.select("query_id", "db", "filename"), ["query_id", "db", "filename"], "left_semi")
    none = candidates.join(valid.select("query_id", "db").distinct(), ["query_id", "db"], "left_anti")
    both = valid.select("query_id", "db", "ord", "filename").unionByName(none)
    order = W.partitionBy("query_id", "db").orderBy("ord")
    return both.withColumn("ord", F.row_number().over(order) - 1).where(F.col("ord") < fv.ANSWER_PAGES)


def gather(selected: DataFrame, page_hits: DataFrame, texts: DataFrame, pages: DataFrame, n_dbs: int = 1) -> DataFrame:
    """Context rows for an answer within the character budget of a database.

    Two best chunks per selected page, or the head of its body; the running total decides
    what is taken whole, what is cut, and what is left out.
    """
    budget = max(fv.ANSWER_CHARS // n_dbs, fv.ANSWER_CHARS_PER_DB)
    per_page = W.partitionBy("query_id", "db", "source").orderBy("rank")
    top = page_hits.withColumn("part", F.row_number().over(per_page)).where(F.col("part") <= fv.CHUNKS_PER_PAGE)
    parts = lexical.with_text(top, texts, ("text", "anchor")).select(
        "query_id", "db", F.col("source").alias("filename"), "part", "text", "anchor")
    label = tx.qualify(F.col("filename"), F.col("db"), F.lit(n_dbs))
    bodies = pages.select("db", "filename", F.left("body", F.lit(fv.PAGE_BODY_CHARS)).alias("_body"))
    rows = (selected.join(parts, ["query_id", "db", "filename"], "left").join(bodies, ["db", "filename"], "left")
            .withColumn("part", F.coalesce("part", F.lit(0))))
    head = F.concat(F.lit("--- "), label, F.when(F.coalesce("anchor", F.lit("")) != "", F.concat(F.lit(" "), "anchor"))
                    .otherwise(""), F.lit(" ---"))
    block = F.concat(F.lit("\n\n"), head, F.lit("\n"), F.coalesce("text", "_body", F.lit("")))
    rows = rows.withColumn("block", block)
    running = W.partitionBy("query_id", "db").orderBy("ord", "part")
    before = F.coalesce(F.sum(F.length("block")).over(running.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return (rows.withColumn("before", before).where(F.col("before") < budget)
            .withColumn("taken", F.least(F.length("block"), budget - F.col("before")))
            .withColumn("block", F.left("block", F.col("taken").cast("int")))
            .select("query_id", "db", "ord", "filename", "part", "before", "taken", "block"))


def answer(contexts: DataFrame, generator) -> DataFrame:
    """Answers from gathered context; the generator is a column function (query_id, context)."""
    text = contexts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("db", "ord", "part", "block"))), lambda s: s["block"]), "").alias("context"))
    return text.withColumn("answer", generator(F.col("query_id"), F.col("context")))


def search_text(hits: DataFrame, n_dbs: int) -> DataFrame:
    """Hits rendered for reading, names qualified when several databases were searched."""
    name: Column = tx.qualify(F.col("source"), F.col("db"), F.lit(n_dbs))
    return hits.withColumn("block", F.format_string(
        "[Raw hit %d]\nfile: %s\nchunk_id: %s\nmatched: %s\nexcerpt: %s\n---", F.col("rank") + 1, name, "chunk_id",
        F.array_join("matched_terms", ", "), "preview"))
