"""Consolidation: pages of one topic and summaries of one document become one page, and links follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import markup as mk
from pagequarry.operators import ingest, resolve
from pagequarry.operators import pages as pg
from pagequarry.session import cut_lineage

# A chain of n renames closes in log2(n) + 1 rounds.
MAX_ROUNDS = 40


def cleanup_plan(pages: DataFrame) -> DataFrame:
    """db, canonical, member, base: which pages become which, and which one leads.

    Summaries go by document, concepts and entities by topic, and what is left with part markers
    is cleaned by itself.  Groups of one page that needs no cleaning are not listed.  A page named
    like a summary is one, whatever its type says.
    """
    pages = pages.where(~F.col("filename").isin(*fv.SYSTEM_PAGES))
    everything = F.concat_ws("\n", "title", "description", "sources", "related", "body")
    marked = pages.where(mk.needs_cleanup(F.col("filename"), everything)).select("db", F.col("filename").alias("member"), F.lit(True).alias("marked"))
    summaries = resolve.summary_plan(pages).select("db", "canonical", "member", "base")
    others = pages.join(summaries.select("db", F.col("member").alias("filename")), ["db", "filename"], "left_anti")
    topics = resolve.merge_plan(resolve.topic_groups(others)).select("db", "canonical", "member", F.col("canonical").alias("base"))
    plans = cut_lineage(summaries.unionByName(topics))
    sizes = plans.groupBy("db", "canonical").agg(F.count("*").alias("n"))
    grouped = (plans.join(sizes, ["db", "canonical"]).join(marked, ["db", "member"], "left")
               .where((F.col("n") > 1) | (F.col("member") != F.col("canonical")) | F.col("marked")))
    alone = marked.join(plans, ["db", "member"], "left_anti").select("db", F.col("member").alias("canonical"), "member", F.col("member").alias("base"))
    return grouped.select("db", "canonical", "member", "base").unionByName(alone)


def closed_renames(renames: DataFrame) -> DataFrame:
    """db, member, canonical with every chain of renames followed to its end, by pointer jumping."""
    step = cut_lineage(renames.where("member <> canonical").select("db", "member", "canonical").distinct())
    for _ in range(MAX_ROUNDS):
        ahead = step.select("db", F.col("member").alias("canonical"), F.col("canonical").alias("_to"))
        jumped = cut_lineage(step.join(ahead, ["db", "canonical"], "left").withColumn("moved", F.col("_to").isNotNull())
                             .select("db", "member", F.coalesce("_to", "canonical").alias("canonical"), "moved"))
        step = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return step
    raise ValueError("pages are renamed in a circle")


def _cleaned(pages: DataFrame) -> DataFrame:
    """Without part markers, sources listed once, with key terms and key facts."""
    clean = (pages.withColumn("title", mk.clean_parts(F.col("title"))).withColumn("description", mk.clean_parts(F.col("description")))
             .withColumn("body", mk.clean_parts(F.col("body"))).withColumn("sources", mk.clean_sources(F.transform("sources", mk.clean_parts)))
             .withColumn("related", F.transform("related", mk.clean_parts)))
    return (clean.withColumn("key_terms", mk.page_key_terms(F.col("title"), F.col("body")))
            .withColumn("body", mk.ensure_key_facts(F.col("title"), F.col("body"))))


def consolidate(pages: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(all pages afterwards, renames): groups merged, merged-out pages gone, links re-pointed, self links and repeats dropped.

    The page that leads comes first in its group, the others by name.  Places are taken from one sorted
    numbering of all pages, so no group is gathered to number it.
    """
    columns = pages.columns
    plan = cut_lineage(cleanup_plan(pages))
    placed = cut_lineage(pages.repartitionByRange("db", "filename").sortWithinPartitions("db", "filename")
                         .withColumn("place", F.monotonically_increasing_id() + 1))
    sizes = plan.groupBy("db", "canonical").agg(F.count("*").alias("n"))
    members = cut_lineage(plan.join(sizes, ["db", "canonical"]).join(placed.withColumnRenamed("filename", "member"), ["db", "member"])
                          .withColumn("ord", F.when(F.col("member") == F.col("base"), 0).otherwise(F.col("place"))).drop("place", "base"))
    alone = members.where("n = 1").withColumn("filename", F.col("canonical")).select(*columns)
    several = ingest.consolidated(members.where("n > 1").drop("n").withColumnRenamed("member", "filename"), today)
    several = several.withColumn("body", mk.ensure_key_facts(F.col("title"), F.col("body")))
    merged = _cleaned(alone.unionByName(pg.finish(several).select(*columns)))
    left = placed.select(*columns).join(plan.select("db", F.col("member").alias("filename")), ["db", "filename"], "left_anti")
    renames = closed_renames(plan)
    return resolve.remap_related(left.unionByName(merged), renames).select(*columns), renames
