"""BM25 search of a table of queries over a table of chunks.

``chunks``: db, scope, source, chunk_id, text.  ``queries``: query_id, db, text and, where
wanted, scope.  The score of a chunk counts every form of every word on both sides.

Two ways lead to the same postings rows (db, scope, source, chunk_id, length, term, tf), held as
one packed row per chunk with the array ``found`` of its terms and their counts:

* :func:`scan_postings` keeps only terms some query asks for; all other words shrink to a length;
* :func:`build_postings` makes the full table, to be stored and searched many times.

Texts are dealt by their chunk into tasks of a bounded number of bytes (:func:`dealt_texts`);
words are counted there and never move.  Packed rows are dealt once more, by a bucket of their
chunk, one bucket a task, into tasks of a bounded number of matches: counts, scores, the best row
of a chunk id and the k best of a query are all taken inside the bucket, so matches never move
either: only k rows per query and task do.  They meet in tasks of a bounded number of rows, each
of which sends on its k best.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import scores as sc
from pagequarry.functions import text as tx
from pagequarry.functions.words import explode_terms, is_counted, query_terms
from pagequarry.session import bounded_broadcast, cut_lineage, unsorted_partitions

CHUNK_KEYS = ["db", "scope", "source", "chunk_id"]
BUCKET = "_bucket"
BYTES_PER_TASK = 8_000_000      # of text, which becomes some 1.5 million terms
MATCHES_PER_TASK = 500_000      # of a query word and a chunk
HITS_PER_TASK = 500_000         # of the k best rows of a query in a bucket
ORDER_DIGITS = 6   # ranks compare scores at this precision, then ids


@dataclass(frozen=True)
class Postings:
    """``rows`` as above; ``corpus``: db, n_rows, mean_length; over all scopes of a database.

    ``tally``, where there is one, is the packed form of the same rows.
    """

    rows: DataFrame
    corpus: DataFrame
    tally: DataFrame | None = None


def unpacked(tally: DataFrame) -> DataFrame:
    """Postings rows of packed ones."""
    return tally.select(*CHUNK_KEYS, "length", F.inline("found"))


def with_questions(chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """Chunk texts plus one more row per hypothetical question (db, chunk_id, question).

    The rows of one chunk id are counted together, so no text is joined to anything.
    """
    keys = chunks.select(*CHUNK_KEYS)
    extra = questions.join(keys, ["db", "chunk_id"]).select(*CHUNK_KEYS, F.col("question").alias("text"))
    return chunks.select(*CHUNK_KEYS, "text").unionByName(extra)


def _corpus(chunks: DataFrame, lengths: DataFrame) -> DataFrame:
    rows = chunks.groupBy("db").agg(F.count("*").alias("n_rows"))
    total = lengths.groupBy("db").agg(F.sum("length").alias("n_terms"))
    return (rows.join(total, "db", "left")
            .select("db", "n_rows", (F.col("n_terms") / F.col("n_rows")).alias("mean_length")))


def tasks(df: DataFrame, amount: Column, per_task: int) -> int:
    """Tasks for a summed ``amount`` of work, as many as there are cores at least."""
    return _at_least_cores(df, df.agg(F.sum(amount)).first()[0] or 0, per_task)


def _at_least_cores(df: DataFrame, total: int, per_task: int) -> int:
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-int(total) // per_task))


def dealt_texts(texts: DataFrame, keys: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """Texts with a ``_bucket`` of their ``keys``, and the ``deal`` of :func:`explode_words`.

    It puts all texts of a bucket (or of another key) in one task of a bounded number of bytes.  Into many partitions
    a writing task sorts its rows in memory, so texts, of which one task may read any amount, are
    dealt into as few first as are written row by row; after that every task writes its share.
    """
    n = tasks(texts, F.octet_length("text"), BYTES_PER_TASK)
    rows = texts.withColumn(BUCKET, F.xxhash64(*keys))
    few = unsorted_partitions(texts.sparkSession)
    return rows if n <= few else rows.repartition(few, BUCKET), lambda paired, by=BUCKET: paired.repartition(n, by)


def packed_postings(texts: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """One row per chunk that has words: its length and the array ``found`` of (term, tf).

    With ``wanted`` (term, asked) only those terms are found; the others count for the length.
    """
    rows, deal = dealt_texts(texts, CHUNK_KEYS)
    keys = [BUCKET, *CHUNK_KEYS]   # with the column dealt by, as a constant key would hide how the rows lie
    terms = explode_terms(rows, F.col("text"), keys, deal) \
        .withColumn("counts", is_counted(F.col("term")).cast("long"))
    if wanted is not None:
        terms = terms.join(wanted, "term", "left").withColumn("term", F.when(F.col("asked"), F.col("term")))
    per_term = terms.groupBy(*keys, "term").agg(F.count("*").alias("tf"), F.sum("counts").alias("counts"))
    return per_term.groupBy(*keys).agg(F.sum("counts").alias("length"), F.collect_list(
        F.when(F.col("term").isNotNull(), F.struct("term", "tf"))).alias("found")).drop(BUCKET)


def _postings(chunks: DataFrame, texts: DataFrame, wanted: DataFrame | None = None) -> Postings:
    tally = cut_lineage(packed_postings(texts, wanted))
    return Postings(unpacked(tally), cut_lineage(_corpus(chunks, tally)), tally)


def scan_postings(chunks: DataFrame, wanted: DataFrame, texts: DataFrame | None = None) -> Postings:
    """Postings of the ``wanted`` terms only.  ``texts`` defaults to the chunk texts."""
    asked = bounded_broadcast(wanted.select("term").distinct().withColumn("asked", F.lit(True)))
    return _postings(chunks, chunks if texts is None else texts, asked)


def build_postings(chunks: DataFrame, texts: DataFrame | None = None) -> Postings:
    """The full postings table, written once in its packed form."""
    return _postings(chunks, chunks if texts is None else texts)


def term_statistics(postings: Postings, wanted: DataFrame | None = None) -> DataFrame:
    """db, term, document frequency and idf; of the ``wanted`` (db, term) only, where given."""
    rows = postings.rows if postings.tally is None else \
        postings.tally.select("db", F.explode("found.term").alias("term"))
    if wanted is not None:
        rows = rows.join(bounded_broadcast(wanted.select("db", "term").distinct()), ["db", "term"], "left_semi")
    df = rows.groupBy("db", "term").agg(F.count("*").alias("df"))
    return df.join(postings.corpus, "db").withColumn("idf", sc.bm25_idf(F.col("n_rows"), F.col("df")))


def asked_terms(queries: DataFrame) -> DataFrame:
    keys = [c for c in ("query_id", "db", "scope") if c in queries.columns]
    return query_terms(queries, keys, F.col("text"))


def _dealt(postings: Postings, asked: DataFrame, n: int) -> DataFrame:
    """Postings rows of asked terms in ``n`` partitions, a ``_bucket`` each, all rows of a chunk in one.

    Packed rows move whole, which is less than their rows of asked terms would be.  The number
    of partitions is fixed: sizes seen by the exchange say nothing about the matches to come.
    """
    wanted = bounded_broadcast(asked.select("db", "term").distinct())
    source = postings.rows.join(wanted, ["db", "term"], "left_semi") if postings.tally is None else \
        postings.tally.where(F.size("found") > 0)
    dealt = source.withColumn(BUCKET, F.pmod(F.xxhash64(*CHUNK_KEYS), F.lit(n)).cast("int")).repartitionById(n, BUCKET)
    return dealt if postings.tally is None else dealt.select(BUCKET, *CHUNK_KEYS, "length", F.inline("found"))


def score(postings: Postings, asked: DataFrame) -> DataFrame:
    """``_bucket``, query_id, chunk keys and unrounded ``bm25`` of every match.

    Grouped by bucket first, so the sums follow the one exchange of :func:`_dealt`.
    """
    return _scored(postings, asked)[0]


def _scored(postings: Postings, asked: DataFrame) -> tuple[DataFrame, int]:
    """:func:`score` and its number of buckets."""
    stats = term_statistics(postings, asked).select("db", "term", "df", "idf", "mean_length")
    scoped = "scope" in asked.columns
    weights = asked.withColumnRenamed("scope", "asked_scope") if scoped else asked
    weights = cut_lineage(weights.join(stats, ["db", "term"]))
    n = tasks(weights, F.col("df"), MATCHES_PER_TASK)
    hits = _dealt(postings, asked, n).join(bounded_broadcast(weights.drop("df")), ["db", "term"])
    if scoped:
        hits = hits.where(F.col("asked_scope").isNull() | (F.col("asked_scope") == F.col("scope")))
    gain = sc.bm25_weight(F.col("idf"), F.col("tf"), F.col("length"), F.col("mean_length"))
    return hits.groupBy(BUCKET, "query_id", *CHUNK_KEYS).agg(F.sum(gain).alias("bm25")), n


def with_matched_terms(hits: DataFrame, postings: Postings, asked: DataFrame) -> DataFrame:
    """Adds the sorted query terms each (already cut) hit contains."""
    few = bounded_broadcast(hits.select("query_id", *CHUNK_KEYS))
    if postings.tally is None:
        rows = postings.rows.select(*CHUNK_KEYS, "term").join(few, CHUNK_KEYS)
    else:
        rows = postings.tally.join(few, CHUNK_KEYS) \
            .select("query_id", *CHUNK_KEYS, F.explode("found.term").alias("term"))
    found = (rows.join(asked.select("query_id", "db", "term"), ["query_id", "db", "term"])
             .groupBy("query_id", *CHUNK_KEYS).agg(F.sort_array(F.collect_set("term")).alias("matched_terms")))
    return hits.join(found, ["query_id", *CHUNK_KEYS])


def _order(value: str, digits: int) -> list[Column]:
    return [F.round(value, digits).desc(), F.col("chunk_id"), F.col("source")]


def top(hits: DataFrame, value: str, k: int | Column, digits: int = ORDER_DIGITS,
        group: tuple[str, ...] = ("query_id", "db")) -> DataFrame:
    """The k best rows per query, with a 0-based ``rank``.

    With a number for ``k`` each task ranks its own rows first (group limit), so at most k rows
    per query and task are shuffled, whatever the number of matches.
    """
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy(*group).orderBy(*_order(value, digits))))
    return ranked.where(F.col("rank") <= k).withColumn("rank", F.col("rank") - 1)


def best(hits: DataFrame, value: str, k: int | Column, digits: int = ORDER_DIGITS,
         group: tuple[str, ...] = ("query_id", "db")) -> DataFrame:
    """:func:`top` of the best row of every chunk id, however many rows share the id."""
    once = W.partitionBy(*group, "chunk_id").orderBy(*_order(value, digits))
    first = hits.withColumn("_n", F.row_number().over(once)).where("_n <= 1").drop("_n")
    return top(first, value, k, digits, group)


def search(chunks: DataFrame, queries: DataFrame, k: int = 10, texts: DataFrame | None = None,
           matched_terms: bool = True) -> DataFrame:
    """Top-k chunks per query: rank, chunk keys, ``score`` (3 digits), ``bm25``, matched terms."""
    asked = cut_lineage(asked_terms(queries))
    return _ranked(scan_postings(chunks, asked, texts), asked, k, matched_terms)


def search_postings(postings: Postings, queries: DataFrame, k: int = 10, matched_terms: bool = True) -> DataFrame:
    """:func:`search` on a stored postings table."""
    return _ranked(postings, cut_lineage(asked_terms(queries)), k, matched_terms)


def _ranked(postings: Postings, asked: DataFrame, k: int, matched_terms: bool) -> DataFrame:
    scored, n_buckets = _scored(postings, asked)
    in_bucket = best(scored, "bm25", k, group=(BUCKET, "query_id", "db")).drop(BUCKET, "rank")
    kept = min(asked.select("query_id", "db").distinct().count() * k, MATCHES_PER_TASK)   # rows a bucket sends on
    n = _at_least_cores(asked, n_buckets * kept, HITS_PER_TASK)
    hits = best(in_bucket.repartition(n, "query_id", "db", "chunk_id"), "bm25", k).withColumn("score", F.round("bm25", 3))
    return with_matched_terms(cut_lineage(hits), postings, asked) if matched_terms else hits


def with_text(hits: DataFrame, chunks: DataFrame, columns: tuple[str, ...] = ("text",)) -> DataFrame:
    """Left join of hits to their chunk rows; a missing text is empty.

    The few wanted chunks are picked by a semi join first, so chunk texts are filtered
    where they are read and only hit texts move.
    """
    ids = bounded_broadcast(hits.select("db", "source", "chunk_id").distinct())
    picked = chunks.join(ids, ["db", "source", "chunk_id"], "left_semi") \
        .select("db", "source", "chunk_id", *columns).dropDuplicates(["db", "source", "chunk_id"])
    joined = hits.join(picked, ["db", "source", "chunk_id"], "left")
    return joined.withColumn("text", F.coalesce("text", F.lit(""))) if "text" in columns else joined


def present(hits: DataFrame) -> DataFrame:
    """The hit projection: adds ``preview``."""
    return hits.withColumn("preview", tx.preview(F.col("text")))


HIT_COLUMNS = ("anchor", "heading_path", "char_start", "char_end", "lang")


def hit_rows(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with everything their chunk row says (place, language, text) and a preview."""
    return present(with_text(hits, chunks, (*HIT_COLUMNS, "text")))


def health(chunks: DataFrame) -> DataFrame:
    """Rows per database for both scopes, zero where a scope is empty."""
    def n(scope: str) -> Column:
        return F.count(F.when(F.col("scope") == scope, 1)).alias(scope)
    return chunks.groupBy("db").agg(n("raw"), n("wiki"))


def per_db_budget(k: int, n_dbs: int) -> int:
    return max(k // n_dbs, fv.MIN_HITS_PER_DB)
