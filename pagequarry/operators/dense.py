"""Vector search: exact cosine top-k of a table of query vectors over a table of vectors.

``vectors``: db, scope, source, chunk_id, vec.  ``queries``: query_id, db, vec and, where
wanted, scope.  A model is a function from a text column to a vector column: a built-in
expression, or a batch function wrapped by :func:`batched_model`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import fixed_values as fv
from pagequarry.functions import scores as sc
from pagequarry.functions import text as tx
from pagequarry.operators import lexical
from pagequarry.operators.lexical import top
from pagequarry.session import unsorted_partitions

Model = Callable[[Column], Column]
SCORE_DIGITS = 6
QUERY_VALUES = 4_000_000     # query values one task may hold (32 MB of doubles)
ROWS_PER_BLOCK = 2048


def letter_model(text: Column) -> Column:
    """Default model: counts of the letters a to z.  Deterministic and free of any download."""
    lower = F.lower(text)
    return F.array(*[tx.count_of(lower, chr(c)).cast("float") for c in range(ord("a"), ord("z") + 1)])


def batched_model(embed: Callable[[list[str]], list[list[float]]],
                  overflow: tuple[str, ...] = ("context length", "exceeds", "too large", "too long")) -> Model:
    """Wrap a batch function whose model refuses long input.

    An error whose text has one of the ``overflow`` phrases means the input was too long.  The
    texts are a list of pieces of work (first row, last row, characters per text): a refused
    piece of several rows becomes its halves, one of a single row goes on with the next shorter
    limit, and the error stands once there is none.
    """
    limits = (None, *fv.EMBED_RETRY_CHARS)

    def smaller(first: int, last: int, tries: int) -> list[tuple[int, int, int]]:
        middle = (first + last) // 2
        if middle > first:
            return [(middle, last, 0), (first, middle, 0)]
        return [(first, last, tries + 1)] if tries + 1 < len(limits) else []

    def vectors(texts: list[str]) -> list[list[float]]:
        done: list = [None] * len(texts)
        work = [(at, min(at + fv.EMBED_BATCH, len(texts)), 0) for at in range(0, len(texts), fv.EMBED_BATCH)]
        while work:
            first, last, tries = work.pop()
            try:
                done[first:last] = embed([t[:limits[tries]] for t in texts[first:last]])
            except Exception as error:
                refused = any(phrase in str(error).lower() for phrase in overflow)
                if not refused or not (parts := smaller(first, last, tries)):
                    raise
                work += parts
        return done

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(vectors(texts.tolist()), index=texts.index)

    return run


def _dealt(rows: DataFrame, head: str, text: str) -> DataFrame:
    """Rows in tasks of a bounded number of bytes of ``head``, however few tasks they are read by.

    A file of one row group is read by one task, whatever its splits.  More tasks than a writing
    task can fill without holding its rows are not made: rows are embedded as they come.
    """
    n = min(lexical.tasks(rows, F.octet_length(head), lexical.BYTES_PER_TASK), unsorted_partitions(rows.sparkSession))
    plain = [c for c, kind in rows.dtypes if kind in ("string", "int", "bigint") and c != text]
    return rows.repartition(n, *plain) if rows.rdd.getNumPartitions() < n else rows


def embed(rows: DataFrame, model: Model = letter_model, text: str = "text") -> DataFrame:
    """``rows`` with a unit-length ``vec``; the text itself is untouched."""
    heads = rows.withColumn("_head", F.left(F.col(text), F.lit(fv.EMBED_CHARS)))
    scaled = F.transform("_raw", lambda x: x.cast("double") / F.col("_norm"))
    return (_dealt(heads, "_head", text).withColumn("_raw", model(F.col("_head"))).withColumn("_norm", sc.norm(F.col("_raw")))
            .withColumn("vec", scaled).drop("_head", "_raw", "_norm"))


def embedded_text(text: Column, page_type: Column, title: Column, description: Column, tags: Column) -> Column:
    """Text a page chunk is embedded with: its identity line leads."""
    return F.concat(F.format_string("type: %s | title: %s | about: %s | tags: %s", page_type, title,
                                    F.coalesce(description, F.lit("")), F.array_join(tags, ", ")),
                    F.lit("\n\n"), text)


_HIT = T.StructType([
    T.StructField("query_id", T.StringType()), T.StructField("db", T.StringType()),
    T.StructField("scope", T.StringType()), T.StructField("source", T.StringType()),
    T.StructField("chunk_id", T.StringType()), T.StructField("similarity", T.DoubleType())])


def _batch_top(rows: pd.DataFrame, query: pd.DataFrame, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """Rows of one batch that may be among the k best of a query; ties at the edge stay in."""
    raw = np.stack(rows["vec"].to_numpy()).astype(np.float64) @ matrix.T
    sims = np.round(raw, SCORE_DIGITS)
    allowed = rows["db"].to_numpy()[:, None] == query["db"].to_numpy()[None, :]
    if "scope" in query:
        asked = query["scope"].to_numpy()
        allowed &= pd.isna(asked)[None, :] | (rows["scope"].to_numpy()[:, None] == asked[None, :])
    sims = np.where(allowed, sims, -np.inf)
    if len(rows) > k:
        edge = -np.partition(-sims, k - 1, axis=0)[k - 1]
        allowed &= sims >= edge[None, :]
    r, q = np.nonzero(allowed)
    out = rows[["db", "scope", "source", "chunk_id"]].iloc[r].reset_index(drop=True)
    out.insert(0, "query_id", query["query_id"].to_numpy()[q])
    return out.assign(similarity=raw[r, q])


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Top-k per query: rank, chunk keys, ``score`` (4 digits).

    Query vectors counted to fit a task are sent to every task; each Arrow batch keeps its
    own k best by one matrix product, so the shuffle carries at most k rows per query and
    batch.  Rows that share a chunk id are all hits.  More queries than that go block by block through a shuffle (:func:`_blockwise`).
    """
    columns = [c for c in ("query_id", "db", "scope") if c in queries.columns]
    asked = queries.select(*columns, "vec")
    first = asked.limit(1).collect()
    if not first:
        return top(vectors.sparkSession.createDataFrame([], _HIT), "similarity", k).withColumn("score", F.lit(0.0))
    limit = max(1, QUERY_VALUES // len(first[0]["vec"]))
    block = asked.limit(limit + 1).toPandas()     # at most limit + 1 rows reach the driver
    if len(block) <= limit:
        matrix = np.stack(block["vec"].to_numpy()).astype(np.float64)
        shared = vectors.sparkSession.sparkContext.broadcast((block.drop(columns="vec"), matrix))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            query, values = shared.value
            for rows in batches:
                if len(rows):
                    yield _batch_top(rows, query, values, k)

        hits = vectors.select("db", "scope", "source", "chunk_id", "vec").mapInPandas(scan, _HIT)
    else:
        hits = _blockwise(vectors, asked, columns, k, limit)
    return top(hits, "similarity", k, SCORE_DIGITS).withColumn("score", F.round("similarity", 4))


def _blockwise(vectors: DataFrame, asked: DataFrame, columns: list[str], k: int, limit: int) -> DataFrame:
    """Blocked matrix product for any number of queries.

    Queries are packed into blocks of bounded size, vectors into blocks of ``ROWS_PER_BLOCK``;
    each vector block is sent once to every query block and only k rows per query leave a
    pair of blocks.  Every task holds one block of each side.
    """
    n_blocks = -(-asked.count() // limit)
    packed_queries = (asked.withColumn("block", F.pmod(F.xxhash64("query_id", "db"), F.lit(2 * n_blocks)))
                      .groupBy("block").agg(F.collect_list(F.struct(*columns, "vec")).alias("queries")))
    part = F.struct("db", "scope", "source", "chunk_id", "vec")
    sized = vectors.withColumn("_slot", F.floor(F.monotonically_increasing_id() / ROWS_PER_BLOCK))
    packed_rows = sized.groupBy("_slot").agg(F.collect_list(part).alias("rows"))
    pairs = (packed_rows.select("rows", F.explode(F.sequence(F.lit(0), F.lit(2 * n_blocks - 1))).alias("block"))
             .join(packed_queries, "block"))

    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows, queries in zip(batch["rows"], batch["queries"], strict=True):
                query = pd.DataFrame([q.asDict() if hasattr(q, "asDict") else dict(q) for q in queries])
                data = pd.DataFrame([r.asDict() if hasattr(r, "asDict") else dict(r) for r in rows])
                matrix = np.stack(query["vec"].to_numpy()).astype(np.float64)
                yield _batch_top(data, query, matrix, k)

    return pairs.select("rows", "queries").mapInPandas(multiply, _HIT)
