"""Point reads: windows of raw text, sections by anchor, listings, question targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import markup as mk
from pagequarry.functions import text as tx
from pagequarry.functions.words import explode_terms
from pagequarry.session import cut_lineage, spread


def read_window(sources: DataFrame, offset: Column) -> DataFrame:
    """16,000 characters from ``offset`` with where they lie and where to go on."""
    total, start = F.length("text"), F.greatest(offset, F.lit(0))
    end = F.least(total, start + fv.READ_WINDOW_CHARS)
    footer = (F.when(start >= total, "(offset past end)")
              .when(end < total, F.format_string("…[truncated; pass offset=%d to continue]", end))
              .when(start > 0, "…[end of file]").otherwise(""))
    return sources.select("db", "source", start.alias("start"), F.when(start < total, end).alias("end"),
                          total.alias("total"), footer.alias("footer"),
                          F.substring("text", start + 1, F.lit(fv.READ_WINDOW_CHARS)).alias("window"))


def read_pages(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, db, filename, found, content, sources, related of every request (request_id, db, filename).

    A page that is not there gives a message as its content.
    """
    have = pages.select("db", "filename", F.lit(True).alias("found"), F.col("body").alias("content"), "sources", "related")
    none = F.array().cast("array<string>")
    return (requests.select("request_id", "db", "filename").join(have, ["db", "filename"], "left")
            .select("request_id", "db", "filename", F.coalesce("found", F.lit(False)).alias("found"),
                    F.when(F.col("found"), F.coalesce("content", F.lit("")))
                    .otherwise(F.concat(F.lit("Page not found: "), "filename")).alias("content"),
                    F.coalesce("sources", none).alias("sources"), F.coalesce("related", none).alias("related")))


def search_scope(chosen: Column, allowed: Column, active: Column) -> Column:
    """Chosen databases that are allowed, in the order chosen; the active one where none is left."""
    left = F.array_intersect(chosen, allowed)
    return F.when(F.size(left) > 0, left).otherwise(F.array(active))


def section_menu(chunks: DataFrame) -> DataFrame:
    """db, source, anchor, pos, next_anchor: distinct anchors of a source in document order."""
    anchors = chunks.where("anchor <> ''").groupBy("db", "source", "anchor").agg(F.min("seq").alias("pos"))
    return anchors.withColumn("next_anchor", F.lead("anchor").over(W.partitionBy("db", "source").orderBy("pos")))


def resolve_sections(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """Chunk each request (request_id, db, source, section) means: equal anchor, else prefix either way."""
    have, want = tx.anchor_key(F.col("anchor")), tx.anchor_key(F.col("section"))
    asked = requests.withColumn("want", want).where("want <> ''")
    rows = chunks.join(asked.select("db", "source").distinct(), ["db", "source"], "left_semi").withColumn("have", have)
    near = (F.col("have") != "") & (F.col("have").startswith(F.col("want")) | F.col("want").startswith(F.col("have")))
    match = F.when(F.col("have") == F.col("want"), 0).when(near, 1)
    hits = rows.join(asked, ["db", "source"]).withColumn("match", match).where("match is not null")
    found = hits.groupBy("request_id", "db", "source").agg(
        F.min(F.struct("match", "seq", "chunk_id", "anchor")).alias("f")).select("request_id", "db", "source", "f.*")
    menu = section_menu(chunks.join(asked.select("db", "source").distinct(), ["db", "source"], "left_semi"))
    return found.join(menu.select("db", "source", "anchor", "next_anchor"), ["db", "source", "anchor"], "left")


def raw_listing(sources: DataFrame) -> DataFrame:
    """One line per text file: its first heading, else its first prose line."""
    lines = F.filter(F.transform(tx.lines(F.col("text")), tx.strip), lambda s: (s != "") & ~s.startswith("<"))
    head = F.get(F.filter(lines, lambda s: s.startswith("#")), F.lit(0))
    hint = F.left(F.when(head.isNotNull(), tx.strip(F.regexp_replace(head, r"\A[# ]+", "")))
                  .otherwise(F.coalesce(F.get(lines, F.lit(0)), F.lit(""))), F.lit(100))
    return (sources.where(tx.file_suffix(F.col("source")).isin(".md", ".txt", ".html"))
            .select("db", "source", hint.alias("hint")))


def is_anchored(anchor: Column, heading_path: Column) -> Column:
    a = tx.strip(F.coalesce(anchor, F.lit("")))
    generic = F.lower(a).rlike(r"\A(?:preamble|präambel|part )")
    return a.startswith("§") | a.startswith("#") | ((a != "") & ~generic) | (F.size(heading_path) > 0)


def question_targets(chunks: DataFrame, k: int = fv.QUESTIONS_PER_SOURCE) -> DataFrame:
    """The k chunks per source worth questions: anchored, dense, long, early."""
    keys = ["db", "source", "seq"]
    density = explode_terms(spread(chunks), F.col("text"), keys).groupBy(*keys).agg(
        F.count_distinct("term").alias("density"))
    known = chunks.select(*keys, "chunk_id", is_anchored(F.col("anchor"), F.col("heading_path")).alias("anchored"),
                          F.length("text").alias("n_chars"), "char_start")
    rows = known.join(density, keys, "left").withColumn("density", F.coalesce("density", F.lit(0)))
    order = W.partitionBy("db", "source").orderBy(F.desc("anchored"), F.desc("density"), F.desc("n_chars"), "char_start", "seq")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def generated_questions(targets: DataFrame, answers: DataFrame, k: int = fv.QUESTIONS_PER_SOURCE) -> DataFrame:
    """Questions a model gave (db, source, chunk_id, pos, question) for its targets, at most k per source.

    Questions for other ids are dropped; a source left without any gets one from its name.
    """
    valid = (answers.withColumn("question", tx.strip(F.col("question"))).where("question <> ''")
             .join(targets.select("db", "source", "chunk_id", F.col("rank").alias("target")), ["db", "source", "chunk_id"]))
    order = W.partitionBy("db", "source").orderBy("pos")
    kept = valid.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("db", "source", "chunk_id", "question")
    lonely = targets.where("rank = 1").join(kept.select("db", "source").distinct(), ["db", "source"], "left_anti")
    return kept.unionByName(lonely.select("db", "source", "chunk_id", tx.title_question(F.col("source")).alias("question")))


def parsed_answers(answers: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answer_id, chunk_id, pos, question; answer_id, error): questions of model answers (answer_id, answer).

    An answer that holds no JSON list is an error row and no failure.  Entries that are no objects, ask
    about a chunk the answer was not given (answer_id, chunk_id) or hold no list of questions are left out.
    """
    read = cut_lineage(answers.select("answer_id", mk.answer_list(F.col("answer")).alias("r")).select(
        "answer_id", F.col("r.error").alias("error"), F.transform("r.entries", lambda e: F.struct(
            tx.strip(F.try_variant_get(e, "$.chunk_id", "string")).alias("chunk_id"),
            F.try_variant_get(e, "$.questions", "array<variant>").alias("q"))).alias("entries")).select(
        "answer_id", "error", F.transform("entries", lambda e: F.struct(e["chunk_id"].alias("chunk_id"), F.transform(
            e["q"], lambda q: tx.strip(F.try_variant_get(q, "$", "string"))).alias("questions"))).alias("entries")))
    each = read.select("answer_id", F.posexplode("entries").alias("entry", "e")).select(
        "answer_id", "entry", "e.chunk_id", F.posexplode("e.questions").alias("n", "question"))
    known = chunks.select("answer_id", "chunk_id").distinct()
    found = each.where("question <> ''").join(known, ["answer_id", "chunk_id"])
    return found.select("answer_id", "chunk_id", F.struct("entry", "n").alias("pos"), "question"), read.where("error IS NOT NULL").select("answer_id", "error")
