"""Approximate nearest neighbours: probed lists are scanned dimension block by dimension block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stored
from pagequarry.llm.pivot_search import as_queries, lifted
from pagequarry.llm.vectors import QUERY_STEP, best, by_length, cut, matrix, packed, sample, valid

# About as many lists as rows in a list; the sample that centroids and probes are fitted on grows with the lists.
SAMPLE, SAMPLE_PER_LIST, ROUNDS, ASKED = 4096, 48, 12, 256
# The hypothesis test abandons a candidate whose partial distance is EPSILON deviations too far.
EPSILON, COLUMNS = 2.1, 16
TARGET_RECALL = 0.97
CHUNK, QUERY_CHUNK, PAIRS, ROWS_AT_ONCE = 4096, 1024, 400_000, 512
HITS = "uid bigint, query_id bigint, vec_id bigint, score double"


@dataclass
class Index:
    """Centroids and the random rotation of the lifted space; ``probes`` lists are scanned for a query."""

    reach: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int

    def rotated(self, x: np.ndarray, as_query: bool) -> np.ndarray:
        return (as_queries(x) if as_query else lifted(x, self.reach)) @ self.rotation


def lists_of(rows: int) -> int:
    return max(1, int(np.sqrt(rows)))


def nearest_lists(points: np.ndarray, centroids: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` nearest centroids of every point, nearest first."""
    far = (centroids ** 2).sum(axis=1) - 2 * points @ centroids.T
    if n < far.shape[1]:
        near = np.argpartition(far, n - 1, axis=1)[:, :n]
        return np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable"), axis=1)
    return np.argsort(far, axis=1, kind="stable")


def homes(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    step = max(1, 8_000_000 // len(centroids))
    return np.concatenate([nearest_lists(points[i:i + step], centroids, 1)[:, 0] for i in range(0, len(points), step)]) if len(points) else np.zeros(0, int)


def fit(x: np.ndarray, reach: float, rows: int, k: int, seed: int = 11) -> Index:
    """Lloyd rounds on the sample, then as many probes as hold TARGET_RECALL of the sample's own neighbours."""
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(x.shape[1] + 1,) * 2))[0]
    index = Index(reach, rotation, np.zeros((1, len(rotation))), 1)
    points = index.rotated(x, False)
    count = min(lists_of(rows), len(x))
    index.centroids = points[rng.permutation(len(points))[:count]]
    for _ in range(ROUNDS):
        home = homes(points, index.centroids)
        sums, held = np.zeros_like(index.centroids), np.bincount(home, minlength=count)
        np.add.at(sums, home, points)
        index.centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], index.centroids)
    home = homes(points, index.centroids)
    asked = rng.permutation(len(x))[:ASKED]
    # The sample is thinner than the table, so its k-th neighbour is farther: as many are asked for as it holds of the true ones.
    share = max(1, min(k, round(k * len(x) / rows), len(x) - 1))
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :share]
    order = np.argsort(nearest_lists(index.rotated(x[asked], True), index.centroids, count), axis=1)
    places = np.sort(np.take_along_axis(order, home[near], axis=1), axis=None)
    index.probes = int(places[int(np.ceil(len(places) * TARGET_RECALL)) - 1]) + 1
    return index


def _listed(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = homes(index.rotated(matrix(batch.column(2)), False), index.centroids)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32))], ["uid", "vec_id", "v", "list"])
    return run


def _probes(index: Index, sizes: np.ndarray, k: int):
    """Per query the lists to scan in their order, and whether a list is among the first that hold ``k`` others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(at, ROWS_AT_ONCE)
                order = nearest_lists(index.rotated(matrix(part.column(2)), True), index.centroids, len(sizes))
                enough = (np.cumsum(sizes[order], axis=1) > k).argmax(axis=1) + 1
                enough[sizes.sum() <= k] = len(sizes)
                counts = np.maximum(index.probes, enough)
                of = np.repeat(np.arange(len(part)), counts)
                lists = np.concatenate([order[i, :n] for i, n in enumerate(counts)]) if len(part) else np.zeros(0, int)
                first = np.concatenate([np.arange(n) < e for n, e in zip(counts, enough, strict=True)]) if len(part) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([*[part.column(i).take(pa.array(of)) for i in range(3)], pa.array(lists.astype(np.int32)), pa.array(first)],
                                                 ["uid", "vec_id", "v", "list", "first"])
    return run


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def _abandon(limit: np.ndarray, seen: int, dims: int) -> np.ndarray:
    """Partial squared distance above which the full one is very likely beyond ``limit``."""
    return limit if seen >= dims else limit * (seen / dims) * (1 + EPSILON / np.sqrt(seen)) ** 2


def scan(uids: np.ndarray, ids: np.ndarray, x: np.ndarray, own: np.ndarray, queries: np.ndarray, floor: np.ndarray, index: Index, k: int):
    """place of the query, vec_id and score of each query's best survivors in one list.

    ``floor`` is what the query has elsewhere.  Rows come in pieces; after each the k-th best so far becomes
    the new limit, so later pieces are abandoned earlier.
    """
    rows, asked = index.rotated(x, False).astype(np.float32), index.rotated(queries, True).astype(np.float32)
    dims, base = rows.shape[1], (asked.astype(np.float64) ** 2).sum(axis=1) + index.reach
    floor = floor.copy()
    held: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0)) for _ in own]
    step = max(1, PAIRS // ROWS_AT_ONCE)
    for at in range(0, len(ids), ROWS_AT_ONCE):
        piece = slice(at, at + ROWS_AT_ONCE)
        block = rows[piece]
        squares = (block[:, :COLUMNS] ** 2).sum(axis=1)
        for first in range(0, len(own), step):
            q = np.arange(first, min(first + step, len(own)))
            # Squared distance of the k-th best so far; rounding never abandons an equal candidate.
            limit = (base[q] - 2 * floor[q]).astype(np.float32) * 1.0001
            part = asked[q, :COLUMNS]
            partial = (part ** 2).sum(axis=1)[:, None] + squares - 2 * part @ block[:, :COLUMNS].T
            who, what = np.nonzero((partial <= _abandon(limit, min(COLUMNS, dims), dims)[:, None]) & (uids[None, piece] != own[q][:, None]))
            far, seen = partial[who, what], COLUMNS
            while seen < dims:
                upto = min(seen + COLUMNS, dims)
                far = far + ((asked[who + first, seen:upto] - block[what, seen:upto]) ** 2).sum(axis=1)
                seen = upto
                keep = far <= _abandon(limit[who], seen, dims)
                who, what, far = who[keep], what[keep], far[keep]
            scores = inner(queries[who + first], x[what + at])
            ends = np.searchsorted(who, np.arange(len(q) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                a, b = ends[i], ends[i + 1]
                known, values = held[q[i]]
                all_ids, all_scores = np.concatenate([known, ids[what[a:b] + at]]), np.concatenate([values, scores[a:b]])
                keep = cut(all_ids, all_scores, k)
                held[q[i]] = all_ids[keep], all_scores[keep]
                if len(keep) == k:
                    floor[q[i]] = max(floor[q[i]], all_scores[keep[-1]])
    return (np.repeat(np.arange(len(own)), [len(h[0]) for h in held]), np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])) \
        if held else (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))


def _scan(index: Index, dim: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                uids, ids, x, own, own_ids, queries, floor = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in enumerate(
                    (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64, np.float64)))
                place, found, scores = scan(uids, ids, x.reshape(-1, dim), own, queries.reshape(-1, dim), floor, index, k)
                yield pa.RecordBatch.from_arrays([pa.array(own[place]), pa.array(own_ids[place]), pa.array(found), pa.array(scores)],
                                                 ["uid", "query_id", "vec_id", "score"])
    return run


def _pack_rows(group: pa.Table) -> pa.Table:
    """One row per group: the key columns, then numbers, ids and vectors (and floors) as packed bytes."""
    keys = [n for n in ("list", "sub", "part") if n in group.column_names]
    group = group.sort_by("uid")
    data = {n: group[n].slice(0, 1).combine_chunks() for n in keys}
    for name in ("uid", "vec_id"):
        data[name] = pa.array([packed(group[name].to_numpy())], pa.binary())
    data["x"] = pa.array([packed(matrix(group["v"].combine_chunks()))], pa.binary())
    if "floor" in group.column_names:
        data["floor"] = pa.array([packed(group["floor"].to_numpy())], pa.binary())
    return pa.table(data)


def _nearest(rows: DataFrame, n: int, reach: float, dim: int, k: int, step: int) -> DataFrame:
    index = fit(sample(rows, max(SAMPLE, SAMPLE_PER_LIST * lists_of(n))), reach, n, k)
    listed = stored(rows.mapInArrow(_listed(index), "uid bigint, vec_id bigint, v array<double>, list int"))
    counts = np.zeros(len(index.centroids), np.int64)
    for r in listed.groupBy("list").agg(F.count("*").alias("n")).collect():   # one row per list: the square root of the rows
        counts[r["list"]] = r["n"]
    long = {int(i): int(-(-c // CHUNK)) for i, c in enumerate(counts) if c > CHUNK}   # at most rows / CHUNK of them
    spark = rows.sparkSession
    chunked = spark.createDataFrame(sorted(long.items()), "list int, chunks int") if long else None

    def with_chunks(df: DataFrame) -> DataFrame:
        return df.withColumn("chunks", F.lit(1)) if chunked is None else df.join(chunked, "list", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    blocks = stored(with_chunks(listed).withColumn("sub", F.pmod(F.xxhash64("uid"), F.col("chunks")).cast("int"))
                    .groupBy("list", "sub").applyInArrow(_pack_rows, "list int, sub int, uid binary, vec_id binary, x binary"))
    asked = stored(rows.where(F.col("vec_id") % step == 0).mapInArrow(
        _probes(index, counts, k), "uid bigint, vec_id bigint, v array<double>, list int, first boolean"))

    def scanned(probes: DataFrame) -> DataFrame:
        """Hits of queries (with their floor) in their lists; many queries of one list go in parts."""
        many = probes.groupBy("list").agg(F.ceil(F.count("*") / QUERY_CHUNK).alias("parts"))
        dealt = (with_chunks(probes.join(many, "list")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
                 .withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "uid"), F.col("parts")).cast("int")))
        packs = (dealt.select("list", "sub", "part", "uid", "vec_id", "v", "floor").groupBy("list", "sub", "part")
                 .applyInArrow(_pack_rows, "list int, sub int, part int, uid binary, vec_id binary, x binary, floor binary")
                 .select("list", "sub", F.col("uid").alias("own"), F.col("vec_id").alias("own_ids"), F.col("x").alias("queries"), "floor"))
        return packs.join(blocks, ["list", "sub"]).select("uid", "vec_id", "x", "own", "own_ids", "queries", "floor").mapInArrow(_scan(index, dim, k), HITS)
    near = stored(scanned(asked.where("first").withColumn("floor", F.lit(float("-inf")))))
    # The k-th best of the nearest lists is the threshold of all others.
    place = F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score")))
    least = near.withColumn("place", place).where(F.col("place") == k).select("uid", F.col("score").alias("floor"))
    far = scanned(asked.where("NOT first").join(least, "uid", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))))
    return near.unionByName(far)


def nearest(table: DataFrame, vector: str = "embedding", k: int = 20, step: int = QUERY_STEP) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found by inner product in double precision.

    An inverted file over the lifted space: every row goes to the list of its nearest centroid;
    a query scans its nearest lists, as many as the sample needed for its own neighbours.  In a
    list, rotated vectors are compared in blocks of columns; after each block a hypothesis test
    abandons candidates whose partial distance is already too far for the query's k-th best.
    The first lists, which hold ``k`` others, give the threshold for the others, and it falls
    while a list is scanned.  Survivors are scored exactly.  A list of many rows is dealt into chunks,
    and many queries of one list into parts, so one list with most of the rows is many tasks.

    Defined cases: as ``vectors.valid`` (no null, empty or non-finite vectors, different vectors of
    one vec_id are different rows, each searched within its length), and vectors of zeros alone take
    no part; ties go to the smaller vec_id; fewer candidates than ``k`` are all returned; an
    empty table gives an empty result; other columns are not read.
    """
    rows = valid(table, vector, lambda x: x, zeros=False)
    hits = None
    for part, n, reach, dim in by_length(rows, step):
        more = _nearest(part, n, reach, dim, k, step)
        hits = more if hits is None else hits.unionByName(more)
    return best(table.sparkSession.createDataFrame([], HITS) if hits is None else hits, k)
