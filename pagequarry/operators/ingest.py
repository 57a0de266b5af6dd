"""Page ingest as one job: model answers become pages, pages find their targets, targets are merged and written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import markup as mk
from pagequarry.functions import text as tx
from pagequarry.functions import words as wd
from pagequarry.operators import pages as pg
from pagequarry.operators import resolve
from pagequarry.session import cut_lineage, spread

STORED = -1   # the place of pages that were there before the batch


# --- routing of a batch, one page after the other -------------------------------------------------------

def _nodes(rows: DataFrame) -> DataFrame:
    """Adds type, tokens and node: pages of one database, type and topic are one node; a page without topic is its own."""
    topic = F.concat_ws("|", F.lit("t"), "db", "type", F.array_join("tokens", " "))
    return (spread(rows).withColumn("type", mk.page_type(F.col("type"))).withColumn("tokens", wd.topic_tokens(F.coalesce("title", "filename")))
            .withColumn("node", F.when(F.size("tokens") > 0, topic).otherwise(F.concat_ws("|", F.lit("f"), "db", "filename"))))


def _name_key() -> Column:
    return F.concat_ws("|", F.lit("n"), "db", "filename")


def _related(new: DataFrame, known: DataFrame) -> DataFrame:
    """node, k: what a page of a node reads or may write: its own, equal and nested topics, and names that stand for several topics.

    Two pages can touch each other only if their nodes have a k in common.
    """
    topics = lambda rows: rows.where(F.size("tokens") > 0).select("db", "type", "tokens").distinct()
    key = lambda side: F.concat_ws("|", F.lit("t"), "db", "type", F.array_join(side, " "))
    mine, theirs = topics(new), topics(new).unionByName(topics(known)).distinct()
    nested = resolve._nested_topics(mine, theirs).select(key("l").alias("node"), key("r").alias("k"))
    reach = nested.unionByName(new.select("node", F.col("node").alias("k"))).distinct()
    named = new.select("db", "filename", "node").unionByName(known.select("db", "filename", "node")).distinct()
    shared = named.groupBy("db", "filename").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    names = named.join(shared, ["db", "filename"], "left_semi").select(F.col("node").alias("k"), _name_key().alias("name"))
    return reach.unionByName(reach.join(names, "k").select("node", F.col("name").alias("k"))).distinct()


def _first_two(rows: DataFrame, key: str) -> DataFrame:
    """key, sig, ord: of every key the two earliest rows of different signature."""
    least = rows.groupBy(key, "sig").agg(F.min("ord").alias("ord"))
    return least.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("ord", "sig"))).where("_n <= 2").drop("_n")


def _ahead(waiting: DataFrame, related: DataFrame) -> DataFrame:
    """node, first (its place), sig, other (place of the first page of another signature): who is first among all that touch a node."""
    at_keys = _first_two(related.join(_first_two(waiting, "node"), "node"), "k")
    at_nodes = _first_two(related.join(at_keys, "k"), "node")
    both = at_nodes.groupBy("node").agg(F.min(F.struct("ord", "sig")).alias("a"), F.max("ord").alias("b"))
    return both.select("node", F.col("a.ord").alias("first"), F.col("a.sig").alias("first_sig"),
                       F.when(F.col("b") > F.col("a.ord"), F.col("b")).alias("other"))


def _trimmed(terms: DataFrame) -> DataFrame:
    """db, filename, term, at, pos: the first twelve terms of every page by when they came in.

    A page keeps its first twelve, so those of any earlier moment are among them.
    """
    first = terms.groupBy("db", "filename", "term").agg(F.min(F.struct("at", "pos")).alias("w"))
    order = W.partitionBy("db", "filename").orderBy("w", "term")
    return (first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= fv.MAX_KEY_TERMS)
            .select("db", "filename", "term", "w.at", "w.pos"))


def _exact(waiting: DataFrame, entries: DataFrame) -> DataFrame:
    """Pages whose topic has a page already: it wins whatever the terms are, so no page before them matters."""
    rows = entries.select("node", F.struct("at", "filename").alias("e"))
    least = rows.groupBy("node").agg(F.min("e").alias("e1"))
    second = rows.join(least, "node").where("e > e1").groupBy("node").agg(F.min("e").alias("e2"))
    met = waiting.where(F.size("tokens") > 0).join(least, "node").join(second, "node", "left")
    pick = lambda e: F.when((e["filename"] != F.col("filename")) & (e["at"] < F.col("ord")), e["filename"])
    return met.withColumn("target", F.coalesce(pick(F.col("e1")), pick(F.col("e2")))).where("target IS NOT NULL").drop("e1", "e2")


def _decided(leaders: DataFrame, related: DataFrame, entries: DataFrame, terms: DataFrame) -> DataFrame:
    """Leaders with ``target`` (a nested topic's page with enough common terms, else their own name) and ``idle``:
    whether the target learns nothing from the page."""
    found = (leaders.join(related, "node").where("k <> node")
             .join(entries.select(F.col("node").alias("k"), F.col("filename").alias("other_name"), "at"), "k")
             .where((F.col("other_name") != F.col("filename")) & (F.col("at") < F.col("ord"))))
    held = (found.select("db", "ord", F.col("other_name").alias("filename")).distinct()
            .join(terms.select("db", "filename", "term", F.col("at").alias("_at")), ["db", "filename"]).where(F.col("_at") < F.col("ord"))
            .groupBy("db", "ord", F.col("filename").alias("other_name")).agg(F.collect_set("term").alias("held")))
    near = found.join(held, ["db", "ord", "other_name"]).where(
        wd.overlap(F.array_distinct("terms"), F.col("held")) >= fv.TERM_OVERLAP)
    idle = (F.size(F.array_except("facts", "held")) == 0) | (F.size("held") >= fv.MAX_KEY_TERMS)
    best = near.groupBy("db", "ord").agg(F.min_by(F.struct(F.col("other_name").alias("name"), idle.alias("idle")), F.struct("at", "other_name")).alias("b"))
    return (leaders.join(best, ["db", "ord"], "left").withColumn("target", F.coalesce("b.name", "filename"))
            .withColumn("idle", F.coalesce("b.idle", F.lit(False))).drop("b"))


def route_batch(batch: DataFrame, registry: DataFrame) -> DataFrame:
    """db, ord, filename, target: where every page of a batch ends up when they come one after the other.

    ``batch``: db, ord (different within a database), filename, title, type, terms (ordered key terms), facts
    (ordered terms of its key facts), fixed (a target decided elsewhere, or null).  ``registry``:
    db, filename, title, type, key_terms.  A page goes to the first page (stored ones by name,
    then new ones by place) of its type and topic, else to the first of a nested topic with enough
    common key terms, else it becomes a page of its own name; a page that takes another in learns
    its terms, at most twelve in all.  So a later page may meet pages and terms that earlier ones brought.

    Runs in rounds: every page whose topic has a page already is settled at once, and so is
    each page that is the first of all open pages it could touch (:func:`_related`); where such a page
    changes nothing, all pages alike up to the next different one follow it.  What was learnt
    carries its place, so a page settled early never shows to an earlier one.  The number of
    rounds is the length of the longest chain of pages that change each other's outcome.
    """
    rows = _nodes(batch).select("db", F.col("ord").cast("bigint").alias("ord"), "filename", "type", "tokens", "node",
                                F.coalesce("terms", F.array().cast("array<string>")).alias("terms"),
                                F.coalesce("facts", F.array().cast("array<string>")).alias("facts"), "fixed")
    rows = cut_lineage(rows)
    known = _nodes(registry).select("db", "filename", "type", "tokens", "node", "key_terms")
    waiting = rows.where("fixed IS NULL")
    related = cut_lineage(_related(waiting, known))
    near = related.select(F.col("k").alias("node")).distinct()
    names = waiting.select("db", "filename").distinct()
    met = known.join(near, "node", "left_semi").unionByName(known.join(near, "node", "left_anti").join(names, ["db", "filename"], "left_semi"))
    entries = cut_lineage(met.select("db", "filename", "node", F.lit(STORED).cast("bigint").alias("at")))
    terms = cut_lineage(_trimmed(met.select("db", "filename", F.lit(STORED).cast("bigint").alias("at"), F.posexplode("key_terms").alias("pos", "term"))))
    # Equal pages decide alike; a name that occurs more than once makes a page differ, as no page goes to itself.
    common = (waiting.select("db", "filename").unionByName(entries.select("db", "filename"))
              .groupBy("db", "filename").agg(F.count("*").alias("n")).where("n > 1").select("db", "filename", F.lit(True).alias("twice")))
    alike = F.xxhash64("node", "terms", "facts", F.when(F.col("twice"), F.col("filename")))
    waiting = cut_lineage(waiting.join(common, ["db", "filename"], "left").withColumn("sig", alike).drop("twice"))
    settled = [rows.where("fixed IS NOT NULL").select("db", "ord", "filename", F.col("fixed").alias("target"))]
    columns = ["db", "ord", "filename", "node", "terms", "facts", "target"]
    while not waiting.isEmpty():
        exact = cut_lineage(_exact(waiting, entries).select(*columns))
        open_ = waiting.join(exact.select("db", "ord"), ["db", "ord"], "left_anti")
        turn = cut_lineage(_ahead(open_, related))
        leaders = open_.join(turn, "node").where("ord = first AND sig = first_sig")
        lead = cut_lineage(_decided(leaders, related, entries, terms).select(*columns, "sig", "idle", "other"))
        followers = (open_.join(lead.where("idle").select("node", "sig", "target", F.col("ord").alias("lead"), "other"), ["node", "sig"])
                     .where((F.col("ord") > F.col("lead")) & (F.col("other").isNull() | (F.col("ord") < F.col("other")))))
        done = cut_lineage(exact.unionByName(lead.select(*columns)).unionByName(followers.select(*columns)))
        own = done.where("target = filename")
        fresh = own.join(entries.select("db", "filename").distinct(), ["db", "filename"], "left_anti")
        entries = cut_lineage(entries.unionByName(fresh.select("db", "filename", "node", F.col("ord").alias("at"))))
        made = fresh.select("db", "ord", F.lit(True).alias("made"))
        learnt = done.join(made, ["db", "ord"], "left").select(
            "db", F.col("target").alias("filename"), F.col("ord").alias("at"), F.posexplode(F.when(F.col("made"), F.col("terms")).otherwise(F.col("facts"))).alias("pos", "term"))
        terms = cut_lineage(_trimmed(terms.unionByName(learnt.select(*terms.columns))))
        settled.append(done.select("db", "ord", "filename", "target"))
        waiting = cut_lineage(waiting.join(done.select("db", "ord"), ["db", "ord"], "left_anti"))
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


# --- from answers to pages -------------------------------------------------------------------------------

def answered_pages(answers: DataFrame, today: Column) -> DataFrame:
    """Page rows of the blocks in model answers (db, ord, source, answer), in order: defaults filled, their source listed."""
    blocks = spread(answers).select("db", "ord", "source", F.posexplode(mk.page_blocks(F.col("answer"))).alias("pos", "_b"))
    raw = blocks.select("db", (F.col("ord").cast("bigint") * F.lit(1 << 16) + F.col("pos")).alias("ord"), "source",
                        F.col("_b.filename").alias("filename"), F.col("_b.content").alias("text"), F.lit(False).alias("is_insight"))
    raw = raw.withColumn("bare", ~F.ltrim(F.regexp_replace("text", rf"\A[{tx.SPACE}]+", "")).startswith("---"))
    parsed = pg.parse_pages(raw, keep=("ord", "source", "bare"))   # an answer without any header is a concept, whatever its name
    return pg.filled(parsed.withColumn("type", F.when(F.col("bare"), "concept").otherwise(F.col("type"))).drop("bare"), F.col("source"), today)


def _targets(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with its target: one summary page per document, else :func:`route_batch`."""
    summary = F.concat(F.lit("summary-"), tx.slug(tx.file_stem(F.regexp_replace("source", mk.PART_SUFFIX, ""))), F.lit(".md"))
    kind = mk.page_type(F.col("type"), F.col("filename"))
    batch = new.select("db", "ord", "filename", "title", kind.alias("type"), mk.page_key_terms(F.col("title"), F.col("body")).alias("terms"),
                       wd.key_terms(F.array_join(mk.key_fact_lines(F.col("body")), "\n")).alias("facts"),
                       F.when(kind == "source-summary", summary).alias("fixed"))
    registry = stored.where(~F.col("filename").isin(*fv.SYSTEM_PAGES)).select("db", "filename", "title", "type", F.when(
        F.size("key_terms") > 0, F.col("key_terms")).otherwise(mk.page_key_terms(F.col("title"), F.col("body"))).alias("key_terms"))
    return cut_lineage(route_batch(batch, registry))


def _live_links(new: DataFrame, stored: DataFrame) -> DataFrame:
    """Links of new pages to pages that were there, or were made by an earlier page of the batch."""
    made = new.groupBy("db", F.col("target").alias("to")).agg(F.min("ord").alias("since"))
    since = made.join(stored.select("db", F.col("filename").alias("to")), ["db", "to"], "left_anti").unionByName(
        stored.select("db", F.col("filename").alias("to"), F.lit(STORED).cast("bigint").alias("since")))
    each = new.select("db", "ord", F.posexplode("related").alias("pos", "_to")).withColumn("to", tx.strip(F.col("_to")))
    kept = each.join(since, ["db", "to"]).where("since < ord").groupBy("db", "ord").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "_to"))), lambda s: s["_to"]).alias("related"))
    return (new.drop("related").join(kept, ["db", "ord"], "left")
            .withColumn("related", F.coalesce("related", F.array().cast("array<string>"))))


def merged_bodies(members: DataFrame, conflicts: DataFrame) -> DataFrame:
    """db, canonical, body: the text of every merged group.

    Lines come from :func:`resolve.merged_lines`; the page the others go into keeps its blank lines.
    The conflicts a page brings stand in a section of their own behind what it brought.
    """
    group = ["db", "canonical"]
    last = F.lit((1 << 31) - 1)
    lines = resolve.merged_lines(members, blanks=True).select(
        *group, F.struct(F.col("home.ord").cast("bigint").alias("a"), F.col("home.section").alias("b"), F.col("ord").cast("bigint").alias("c"),
                         F.col("section").alias("d"), F.col("line_no").alias("e"), F.lit("").alias("f"), "line").alias("row"))
    head = conflicts.select(*group, "ord").distinct().select(*group, "ord", F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.lit("").alias("line")), F.struct(F.lit(1).alias("at"), F.lit("## Contradictions").alias("line")))).alias("h"))
    told = head.select(*group, "ord", F.col("h.at").alias("at"), F.lit("").alias("key"), F.col("h.line").alias("line")).unionByName(
        conflicts.select(*group, "ord", F.lit(2).alias("at"), "key", F.concat(F.lit("- "), "sentence").alias("line")))
    added = told.select(*group, F.struct(F.col("ord").cast("bigint").alias("a"), last.alias("b"), F.col("ord").cast("bigint").alias("c"), F.lit(0).alias("d"),
                                         F.col("at").alias("e"), F.col("key").alias("f"), "line").alias("row"))
    rows = lines.unionByName(added).groupBy(*group).agg(F.array_sort(F.collect_list("row")).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["line"]), "\n")
    return rows.select(*group, F.concat(tx.strip(text), F.lit("\n")).alias("body"))


def consolidated(members: DataFrame, today: Column) -> DataFrame:
    """One page per group (db, canonical): page rows with ``ord``, 0 being the page the others are merged into."""
    group = ["db", "canonical"]
    members = cut_lineage(members)
    conflicts = cut_lineage(resolve.merged_conflicts(members, today))
    header = resolve.merged_header(members, conflicts, today)
    merged = header.join(merged_bodies(members, conflicts), group)
    renewed = ("sources", "related", "key_terms", "created", "body")
    base = members.where("ord = 0").drop("ord", "filename", *renewed, "n_pages") \
        .withColumnsRenamed({"updated": "_updated", "confidence": "_confidence"})
    out = (merged.join(base, group).withColumn("filename", F.col("canonical"))
           .withColumn("updated", F.coalesce("updated", "_updated")).withColumn("confidence", F.coalesce("confidence", "_confidence")))
    return out.drop("canonical", "n_pages", "_updated", "_confidence")


def ingest(stored: DataFrame, answers: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(pages written, outcome): the pages a batch of model answers creates or changes.

    ``stored``: page rows as :func:`pages.parse_pages` gives them; ``answers``: db, ord, source,
    answer.  The first returned frame has the columns of ``stored``; the second says per target
    whether it is new, and how many pages of the batch went into it.
    """
    new = cut_lineage(answered_pages(answers, today))
    new = new.join(_targets(new, stored), ["db", "ord", "filename"])
    new = cut_lineage(_live_links(new, stored))
    base = stored.join(new.select("db", F.col("target").alias("filename")).distinct(), ["db", "filename"], "left_semi") \
        .withColumn("canonical", F.col("filename")).withColumn("ord", F.lit(STORED).cast("bigint")).withColumn("was", F.lit(True))
    rows = base.unionByName(new.withColumnRenamed("target", "canonical").drop("source"), allowMissingColumns=True)
    first = rows.groupBy("db", "canonical").agg(F.min("ord").alias("first"), F.count("*").alias("n"), F.max("was").alias("was"))
    members = rows.drop("was").join(first, ["db", "canonical"]).withColumn("ord", F.when(F.col("ord") == F.col("first"), F.lit(0)).otherwise(F.col("ord") + 1))
    members = cut_lineage(members.drop("first", "was"))
    alone = members.where("n = 1").withColumn("filename", F.col("canonical")).drop("n", "ord", "canonical")
    several = consolidated(members.where("n > 1").drop("n"), today)
    several = several.withColumn("key_terms", mk.page_key_terms(F.col("title"), F.col("body"))).withColumn("body", mk.ensure_key_facts(F.col("title"), F.col("body")))
    written = pg.finish(alone.unionByName(several, allowMissingColumns=True)).select(*stored.columns)
    outcome = first.select("db", F.col("canonical").alias("filename"), F.when(F.col("was"), "updated").otherwise("created").alias("status"),
                           (F.col("n") - F.when(F.col("was"), 1).otherwise(0)).alias("n_pages"))
    return written, outcome
