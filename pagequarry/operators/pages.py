"""Operators on the page table: listing, stamping, upserts, deletes, log, checks.

``pages``: db, filename, title, type, sources, related, key_terms, created, updated,
effective_date, expires_after_days, description, part_of, body, is_insight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as dt
from pagequarry.functions import markup as mk
from pagequarry.functions import text as tx
from pagequarry.session import cut_lineage


def _strings() -> Column:
    return F.array().cast("array<string>")


def listed(pages: DataFrame, include_insights: bool = False) -> DataFrame:
    """Real pages with a description; insights come under their own prefix and type."""
    rows = pages.where(~F.col("filename").isin(*fv.SYSTEM_PAGES))
    rows = rows if include_insights else rows.where(~F.col("is_insight"))
    blurb = F.replace(F.left("body", F.lit(120)), F.lit("\n"), F.lit(" "))
    return (rows.withColumn("filename", F.when(F.col("is_insight"), F.concat(F.lit("insights/"), "filename"))
                            .otherwise(F.col("filename")))
            .withColumn("type", F.when(F.col("is_insight"), "insight").otherwise(F.col("type")))
            .withColumn("description", F.coalesce("description", blurb)))


def stamp(pages: DataFrame) -> DataFrame:
    """Derived header fields (type, description, tags, resource, timestamp); stated ones stay."""
    kind = mk.page_type(F.col("type"))
    stated = F.when(~tx.is_blank(F.coalesce("description", F.lit(""))), F.col("description"))
    return (pages.withColumn("type", F.when(F.trim(F.coalesce("type", F.lit(""))) == "", kind).otherwise(F.col("type")))
            .withColumn("description", F.coalesce(stated, mk.description(F.col("body"))))
            .withColumn("tags", mk.tags(F.col("db"), kind, F.col("part_of")))
            .withColumn("resource", mk.resource(kind, F.col("sources")))
            .withColumn("timestamp", dt.iso_timestamp(F.coalesce("updated", "created"))))


def finish(pages: DataFrame) -> DataFrame:
    """Stamped pages with one numbered citation section at the end of the body."""
    return stamp(pages).withColumn("body", mk.with_citations(F.col("body"), F.col("sources")))


def parse_pages(raw: DataFrame, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Page rows of Markdown files with a header: db, filename, text and is_insight in, columns ``keep`` unchanged."""
    t = F.col(text)
    known = ["title", "type", "sources", "related", "key_terms", "created", "updated", "effective as of",
             "expires_after_days", "description", "part of", "tags", "resource", "timestamp", "confidence"]
    return raw.select(
        *keep, "db", "filename", "is_insight", mk.header_value(t, "title").alias("title"),
        mk.header_value(t, "type").alias("type"), mk.header_list(t, "sources").alias("sources"),
        mk.header_list(t, "related").alias("related"), mk.header_list(t, "key_terms").alias("key_terms"),
        dt.iso_day(mk.header_value(t, "created")).alias("created"),
        dt.iso_day(mk.header_value(t, "updated")).alias("updated"),
        dt.iso_day(mk.header_value(t, "effective as of")).alias("effective_date"),
        mk.header_value(t, "expires_after_days").try_cast("int").alias("expires_after_days"),
        mk.header_value(t, "description").alias("description"), mk.header_value(t, "part of").alias("part_of"),
        mk.header_value(t, "confidence").alias("confidence"),
        mk.header_extras(t, known).alias("extra"), mk.body(t).alias("body"))


def with_defaults(new_pages: DataFrame, source: Column, existing: DataFrame, today: Column) -> DataFrame:
    """Model-written pages made storable: defaults, their source listed, dead links dropped, key terms, key facts."""
    made = filled(new_pages, source, today)
    each = made.select("db", "filename", F.posexplode("related").alias("pos", "to"))
    live = each.join(existing.select("db", F.col("filename").alias("to")), ["db", "to"], "left_semi")
    kept = live.groupBy("db", "filename").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda s: s["to"]).alias("related"))
    return (made.drop("related").join(kept, ["db", "filename"], "left")
            .withColumn("related", F.coalesce("related", _strings())))


def filled(new_pages: DataFrame, source: Column, today: Column) -> DataFrame:
    """:func:`with_defaults` without the look at the links."""
    plain = F.initcap(F.replace(F.replace("filename", F.lit(".md"), F.lit("")), F.lit("-"), F.lit(" ")))
    return (new_pages.withColumn("title", F.coalesce("title", plain)).withColumn("type", mk.page_type(F.col("type"), F.col("filename")))
            .withColumn("created", F.coalesce("created", today)).withColumn("updated", F.coalesce("updated", today))
            .withColumn("confidence", F.coalesce("confidence", F.lit("low")))
            .withColumn("sources", F.array_union(F.coalesce("sources", _strings()), F.array(source)))
            .withColumn("key_terms", mk.page_key_terms(F.col("title"), F.col("body")))
            .withColumn("body", mk.ensure_key_facts(F.col("title"), F.col("body"))))


def upsert(pages: DataFrame, changed: DataFrame, keys: tuple[str, ...] = ("db", "filename")) -> DataFrame:
    """Rows of ``changed`` replace rows of equal key or are added."""
    return pages.join(changed.select(*keys), list(keys), "left_anti").unionByName(changed, allowMissingColumns=True)


def replace_source(rows: DataFrame, new_rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Final state after all rows of ``sources`` (db, source) are replaced by ``new_rows``."""
    return rows.join(sources, ["db", "source"], "left_anti").unionByName(new_rows)


def delete_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources, ["db", "source"], "left_anti")


def cascade_delete(pages: DataFrame, deleted: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(pages left, pages removed) after sources are deleted (db, source).

    A listed source goes if its name starts with a deleted name: each source is looked up by its
    prefixes of the lengths that deleted names of its database have.  A page that had sources
    and keeps none is removed, and links to removed pages are scrubbed.
    """
    gone = deleted.where("source <> ''").select("db", F.col("source").alias("base")).distinct()
    lengths = gone.groupBy("db").agg(F.collect_set(F.length("base")).alias("lengths"))
    each = pages.select("db", "filename", F.posexplode("sources").alias("pos", "source"))
    named = each.select("db", "source").distinct().join(lengths, "db")
    prefixes = named.select("db", "source", F.explode("lengths").alias("n")).where(F.col("n") <= F.length("source")) \
        .withColumn("base", F.left("source", F.col("n")))
    hit = prefixes.join(gone, ["db", "base"], "left_semi").select("db", "source").distinct().withColumn("gone", F.lit(True))
    kept = (each.join(hit, ["db", "source"], "left").groupBy("db", "filename").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "source")))),
                    lambda s: s["source"]).alias("kept"),
        F.count("*").alias("n_before")))
    judged = pages.join(kept, ["db", "filename"], "left").withColumn("kept", F.coalesce("kept", _strings()))
    emptied = (F.coalesce("n_before", F.lit(0)) > 0) & (F.size("kept") == 0)
    removed = judged.where(emptied).select("db", "filename")
    left = (judged.where(~emptied)
            .withColumn("_touched", F.coalesce("n_before", F.lit(0)) != F.size("kept"))
            .withColumn("sources", F.col("kept")).drop("kept", "n_before"))
    links = left.select("db", "filename", F.posexplode("related").alias("pos", "to"))
    dead = links.join(removed.select("db", F.col("filename").alias("to")), ["db", "to"], "left_semi")
    dead_lists = dead.groupBy("db", "filename").agg(F.collect_set("to").alias("dead"))
    out = (left.join(dead_lists, ["db", "filename"], "left")
           .withColumn("related", F.when(F.col("dead").isNull(), F.col("related"))
                       .otherwise(F.filter("related", lambda r: ~F.array_contains(F.col("dead"), r))))
           .withColumn("updated", F.when(F.col("_touched") | F.col("dead").isNotNull(), today).otherwise(F.col("updated")))
           .drop("_touched", "dead"))
    return out, removed


def index_lines(pages: DataFrame) -> DataFrame:
    """db, part (0 pages, 1 insights), filename, line: the index page as ordered rows."""
    line = F.format_string("* [%s](%s) - %s", F.coalesce("title", "filename"), "filename",
                           F.coalesce("description", F.lit("")))
    return listed(pages, include_insights=True).select(
        "db", (F.col("type") == "insight").cast("int").alias("part"), "filename", line.alias("line"))


def tree(pages: DataFrame, today: Column) -> DataFrame:
    """Pages by type group with their freshness."""
    kind = F.lower(F.trim(F.coalesce("type", F.lit(""))))
    return listed(pages, include_insights=True).select(
        "db", F.when(kind.isin(*fv.PAGE_TYPE_GROUPS), kind).otherwise("other").alias("group"), "filename",
        dt.is_stale(F.col("updated"), F.col("expires_after_days"), today).alias("stale"))


def stale_pages(pages: DataFrame, today: Column) -> DataFrame:
    return tree(pages, today).where("stale").select("db", "filename")


def issues(pages: DataFrame, index_pages: DataFrame) -> DataFrame:
    """Format problems: no index page, no format version in it, pages without type."""
    dbs = pages.select("db").distinct()
    index = index_pages.select("db", "format_version")
    missing = dbs.join(index, "db", "left_anti").select("db", F.lit("index.md: missing").alias("issue"))
    version = index.where(F.coalesce(F.trim("format_version"), F.lit("")) != fv.PAGE_FORMAT_VERSION) \
        .select("db", F.lit(f'index.md: missing format version "{fv.PAGE_FORMAT_VERSION}"').alias("issue"))
    untyped = pages.where(~F.col("filename").isin(*fv.SYSTEM_PAGES) & (F.trim(F.coalesce("type", F.lit(""))) == "")) \
        .select("db", F.concat("filename", F.lit(": empty/missing required `type`")).alias("issue"))
    return missing.unionByName(version).unionByName(untyped)


def stats(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages, raw files and bytes per database."""
    p = pages.groupBy("db").agg(F.count(F.when(~F.col("filename").isin(*fv.SYSTEM_PAGES), 1)).alias("pages"),
                                F.sum(F.octet_length("body")).alias("page_bytes"))
    s = sources.groupBy("db").agg(F.count("*").alias("raw_files"), F.sum(F.octet_length("text")).alias("raw_bytes"))
    return (p.join(s, "db", "full").select(
        "db", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("raw_files", F.lit(0)).alias("raw_files"),
        (F.coalesce("page_bytes", F.lit(0)) + F.coalesce("raw_bytes", F.lit(0))).alias("data_bytes")))


def filed_answers(answers: DataFrame, today: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """Insight pages of answered questions (db, question, answer, related), columns ``keep`` unchanged."""
    slug = tx.slug(tx.strip(F.left("question", F.lit(80))))
    title = tx.strip(F.regexp_replace(tx.strip(F.col("question")), r"[?.!]+\z", ""))
    return answers.select(
        *keep, "db", F.concat(F.lit("insight-"), F.when(slug == "", "insight").otherwise(slug), F.lit(".md")).alias("filename"),
        F.when(title == "", "Insight").otherwise(title).alias("title"), F.lit("comparison").alias("type"),
        F.array(F.lit("chat")).alias("sources"), F.coalesce("related", _strings()).alias("related"),
        today.alias("created"), today.alias("updated"), F.lit("medium").alias("confidence"), F.lit(True).alias("is_insight"),
        F.concat(F.lit("## Question\n"), tx.strip(F.col("question")), F.lit("\n\n## Answer\n"),
                 tx.strip(F.col("answer")), F.lit("\n")).alias("body"))


def merge_windows(ranked: DataFrame, pages: DataFrame) -> DataFrame:
    """Existing text of affected pages, cut to the budget of their rank."""
    budgets = F.array(*[F.lit(b) for b in fv.MERGE_CHARS_BY_RANK])
    budget = F.get(budgets, F.least(F.col("rank"), F.lit(len(fv.MERGE_CHARS_BY_RANK) - 1)))
    text = F.when(F.length("body") > budget, F.concat(F.left("body", budget), F.lit("\n…[truncated]"))).otherwise(F.col("body"))
    return ranked.join(pages.select("db", "filename", "body"), ["db", "filename"]).withColumn("window", text).drop("body")


# --- activity log ---------------------------------------------------------------------------

def log_view(log: DataFrame) -> DataFrame:
    """db, day, line, in rendering order: newest day first, newest entry first."""
    detail = F.trim(tx.squeeze(F.coalesce("detail", F.lit(""))))
    line = F.concat(F.lit("- "), "time", F.lit(" — "), "action", F.when(detail != "", F.concat(F.lit(": "), detail)).otherwise(""))
    return log.select("db", "day", "time", "seq", line.alias("line")).orderBy("db", F.desc("day"), F.desc("time"), F.desc("seq"))


_LEGACY = r"\A##\s+(\d{4}-\d{2}-\d{2})[ T](\d{2}:\d{2})\s+[—-]\s+(.*)\z"


def legacy_log(logs: DataFrame, text: str = "text") -> DataFrame:
    """Entries of flat logs: each heading opens an entry, the lines below are its detail."""
    lines = F.transform(mk.split_lines(F.col(text)), tx.strip)
    opens = F.filter(F.transform(lines, lambda s, i: F.when(s.rlike(_LEGACY), i)), lambda i: i.isNotNull())

    def entry(at: Column, n: Column) -> Column:
        head = F.get(lines, at)
        rest = F.slice(lines, at + 2, F.coalesce(F.get(opens, n + 1), F.size(lines)) - at - 1)
        return F.struct(n.alias("seq"), F.regexp_extract(head, _LEGACY, 1).alias("day"),
                        F.regexp_extract(head, _LEGACY, 2).alias("time"), F.regexp_extract(head, _LEGACY, 3).alias("action"),
                        F.array_join(F.filter(rest, lambda s: s != ""), " ").alias("detail"))

    return logs.select("db", F.inline(F.transform(opens, entry)))


def rewritten_log(lines: DataFrame) -> DataFrame:
    """db, day_at, entry_at, line: flat logs (db, line_no, line) rewritten under day headings, as ordered rows.

    Each heading line opens an entry, the lines up to the next one are its detail.  Days come
    in the order of day_at, entries of a day in that of entry_at, both from large to small: the day and the entry that
    came last stand first.  A log without any heading keeps its lines (day_at null, entry_at rising).

    Logs of any length are read in one sorted exchange.  A partition looks for its headings by
    itself; for the lines before its first one the last heading of the partitions before is carried
    on, from one row per partition and log.
    """
    clean = lines.select("db", "line_no", tx.strip(F.col("line")).alias("line"))
    opens = F.when(F.col("line").rlike(_LEGACY), F.col("line_no"))
    placed = cut_lineage(clean.repartitionByRange("db", "line_no").sortWithinPartitions("db", "line_no")
                         .select("*", opens.alias("opens"), F.spark_partition_id().alias("part")))
    last = placed.groupBy("db", "part").agg(F.max("opens").alias("last"))
    before = W.partitionBy("db").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    carried = last.select("db", "part", F.max("last").over(before).alias("carried"))
    inside = W.partitionBy("db", "part").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)
    owned = (placed.withColumn("mine", F.max("opens").over(inside)).join(carried, ["db", "part"])
             .withColumn("entry_at", F.coalesce("mine", "carried")))
    head = owned.where("opens IS NOT NULL").select("db", "entry_at", *[F.regexp_extract("line", _LEGACY, n).alias(c) for n, c in
                                                                      ((1, "day"), (2, "time"), (3, "action"))])
    detail = (owned.where("opens IS NULL AND entry_at IS NOT NULL AND line <> ''").groupBy("db", "entry_at")
              .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), " ").alias("detail")))
    days = head.groupBy("db", "day").agg(F.min("entry_at").alias("day_at"))
    told = tx.squeeze(F.col("detail"))
    bullet = F.concat(F.lit("- "), "time", F.lit(" — "), "action", F.when(told != "", F.concat(F.lit(": "), told)).otherwise(""))
    entries = head.join(days, ["db", "day"]).join(detail, ["db", "entry_at"], "left")
    found = entries.select("db", "day_at", "entry_at", bullet.alias("line")).unionByName(
        days.select("db", "day_at", F.lit((1 << 63) - 1).alias("entry_at"), F.concat(F.lit("## "), "day").alias("line")))
    flat = placed.join(head.select("db").distinct(), "db", "left_anti")
    return found.unionByName(flat.select("db", F.lit(None).cast("bigint").alias("day_at"), F.col("line_no").cast("bigint").alias("entry_at"), "line"))


# --- source registry ----------------------------------------------------------------------------

def register(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """New manifest rows of uploads (db, ord, filename, sha256): known contents are dropped.

    Of equal contents in one batch the first counts.  A name already taken by another content
    gets the first eight digits of the hash.
    """
    fresh = incoming.join(manifest.select("db", "sha256"), ["db", "sha256"], "left_anti")
    first = fresh.groupBy("db", "sha256").agg(F.min(F.struct("ord", "filename")).alias("f")) \
        .select("db", "sha256", F.col("f.ord").alias("ord"), F.col("f.filename").alias("filename"))
    taken = manifest.select("db", "filename").distinct().withColumn("_taken", F.lit(True))
    leader = first.groupBy("db", "filename").agg(F.min("ord").alias("_leader"))
    collides = F.col("_taken").isNotNull() | (F.col("ord") != F.col("_leader"))
    suffixed = F.concat(tx.file_stem(F.col("filename")), F.lit("_"), F.left("sha256", F.lit(8)),
                        F.regexp_extract("filename", r"(?<=.)(\.[^.]*)$", 1))
    return (first.join(taken, ["db", "filename"], "left").join(leader, ["db", "filename"])
            .select("db", "sha256", F.when(collides, suffixed).otherwise(F.col("filename")).alias("filename")))


def deregister(manifest: DataFrame, names: DataFrame) -> DataFrame:
    """Manifest without the first entry of each given file name (db, filename)."""
    first = manifest.join(names, ["db", "filename"], "left_semi") \
        .groupBy("db", "filename").agg(F.min("sha256").alias("sha256"))
    return manifest.join(first, ["db", "filename", "sha256"], "left_anti")


def first_visits(visits: DataFrame, keys: list[str]) -> DataFrame:
    """First step of every key, and how often it was asked again."""
    return visits.groupBy(*keys).agg(F.min("step").alias("first_step"), (F.count("*") - 1).alias("repeats"))


def split_seen(asked: DataFrame, memory: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fresh, seen) rows by the keys already in ``memory``."""
    return asked.join(memory.select(*keys), keys, "left_anti"), asked.join(memory.select(*keys), keys, "left_semi")


def ordered_queue(uploads: DataFrame) -> DataFrame:
    """Batch order of uploads: by effective date, undated first."""
    return uploads.orderBy(F.asc_nulls_first("effective_date"), "filename")


def batch_counts(ingested: DataFrame) -> DataFrame:
    """Totals of a batch: created, updated, contradictions."""
    return ingested.agg(*[F.sum(F.size(c)).alias(c) for c in ("created", "updated", "contradictions")])


def ranked_per(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)
