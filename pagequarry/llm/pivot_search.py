"""Exact top-k search: a table of pivot distances bounds every score before it is computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import stored
from pagequarry.llm.vectors import QUERY_STEP, best, by_length, cut, matrix, packed, sample, valid

SCALE, PIVOTS, PIVOT_SAMPLE = 64, 64, 2000
BLOCK, CHUNK = 4096, 512
HITS = "uid bigint, query_id bigint, vec_id bigint, score bigint"
BLOCKS = ("c bigint, uids binary, ids binary, x binary, `table` binary, low array<double>, high array<double>, own_uids binary, own_ids binary, own_x binary, "
          "least binary, query_low array<double>, query_high array<double>, floor double, longest double, found binary")
_HIT = np.dtype([("uid", "<i8"), ("query_id", "<i8"), ("vec_id", "<i8"), ("score", "<i8")])


def choose_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first: each pivot is the sample point farthest from those before it."""
    chosen = points[:1]
    distance = np.full(len(points), np.inf)
    while 0 < len(chosen) < min(count, len(points)):
        distance = np.minimum(distance, ((points - chosen[-1]) ** 2).sum(axis=1))
        chosen = np.vstack([chosen, points[np.argmax(distance)]])
    return chosen


def lifted(x: np.ndarray, reach: float) -> np.ndarray:
    """One more component brings every vector to the length of the longest, so that a larger
    inner product with a query (lifted by 0) is a smaller distance."""
    return np.hstack([x, np.sqrt(np.maximum(reach - (x * x).sum(axis=1), 0))[:, None]])


def as_queries(x: np.ndarray) -> np.ndarray:
    return np.hstack([x, np.zeros((len(x), 1))])


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (points ** 2).sum(axis=1)[:, None] + (pivots ** 2).sum(axis=1) - 2 * points @ pivots.T
    return np.sqrt(np.maximum(squares, 0)).astype(np.float32)


def slack(reach: float) -> float:
    """How far a tabled distance may be off: 32-bit rounding and cancellation, with room to spare."""
    return 1e-5 * (1 + np.sqrt(reach))


def upper(longest, reach, gap):
    """Largest inner product at a distance of at least ``gap`` (after the slack) from a query of that squared length."""
    return (longest + reach - gap * gap) / 2 * (1 + 1e-12) + 1 + 1e-12 * reach


def exact(x: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides in the cheapest kind of number whose products are exact: 32 bits to 2^24, 64 bits to 2^53, whole ones beyond."""
    most = x.shape[1] * max(np.abs(x).max(initial=0), np.abs(queries).max(initial=0)) ** 2
    if most < 2 ** 53:
        kind = np.float32 if most < 2 ** 24 else np.float64
        return x.astype(kind), queries.astype(kind)
    if most < 2 ** 62:
        return x.astype(np.int64), queries.astype(np.int64)
    # Beyond that single products may leave 64 bits; a result that does raises an error when it is told.
    whole = np.frompyfunc(int, 1, 1)
    return whole(x), whole(queries)


def search_block(uids: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, query: np.ndarray, own: int, longest: float,
                 to_pivots: np.ndarray, reach: float, k: int, least=-np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Exact top ``k`` of one query in one block: candidates in bound order until none can enter.

    The largest difference of pivot distances bounds the distance from below, hence the inner
    product from above; a candidate is skipped only if its bound is below the k-th score so far, which
    is ``least`` at first.
    """
    gap = np.maximum(np.abs(table - to_pivots).max(axis=1).astype(np.float64) - slack(reach), 0)
    bound = upper(longest, reach, gap)
    bound[uids == own] = -np.inf
    rest = np.flatnonzero((bound >= least) & (bound > -np.inf))
    if len(rest) > CHUNK:   # the best bounds first, the others only if they can still enter
        rest = rest[np.argpartition(-bound[rest], CHUNK - 1)]
    found, values, first, step = np.zeros(0, np.int64), np.zeros(0, x.dtype), 0, CHUNK
    while first < len(rest):
        part = rest[first:first + step]
        all_ids, all_scores = np.concatenate([found, ids[part]]), np.concatenate([values, x[part] @ query])
        keep = cut(all_ids, all_scores, k)
        found, values = all_ids[keep], all_scores[keep]
        least = max(least, values[-1]) if len(values) == k else least
        first += step
        if step == CHUNK:
            tail = rest[first:]
            tail = tail[bound[tail] >= least]
            rest, first, step = tail[np.argsort(-bound[tail])], 0, 4 * CHUNK
        elif first < len(rest) and bound[rest[first]] < least:
            break
    return found, values


def _cells(pivots: np.ndarray, reach: float):
    """Adds the nearest pivot of every row and the distance to it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lifted(matrix(batch.column(2)), reach), pivots)
            home = far.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(far[np.arange(len(home)), home].astype(np.float64))],
                                             ["uid", "vec_id", "v", "cell", "away"])
    return run


def _blocks(pivots: np.ndarray, reach: float, k: int, step: int, size: int):
    """Blocks of neighbouring rows of one cell; the queries of a block are searched in it at once, for a first threshold."""
    def block(uids, ids, x, c) -> list:
        table = distances(lifted(x, reach), pivots)
        asked = np.flatnonzero(ids % step == 0)
        to_pivots, longest = distances(as_queries(x[asked]), pivots), (x[asked] ** 2).sum(axis=1)
        points, queries = exact(x, x[asked])
        hits = [search_block(uids, ids, points, table, queries[i], uids[a], longest[i], to_pivots[i], reach, k) for i, a in enumerate(asked)]
        least = np.array([float(h[1][-1]) if len(h[1]) == k else -np.inf for h in hits])
        found = np.array([(uids[a], ids[a], i, int(s)) for a, h in zip(asked, hits, strict=True) for i, s in zip(*h, strict=True)], _HIT)
        ends = lambda t: [t.min(axis=0).astype(float).tolist(), t.max(axis=0).astype(float).tolist()] if len(t) else [None, None]
        return [c, packed(uids), packed(ids), packed(x), packed(table), *ends(table), packed(uids[asked]), packed(ids[asked]), packed(x[asked]), packed(least), *ends(to_pivots),
                float(least.min()) if len(least) else None, float(longest.max()) if len(longest) else None, packed(found)]

    kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, pa.float64(), pa.float64(), pa.binary()]
    names = ["c", "uids", "ids", "x", "table", "low", "high", "own_uids", "own_ids", "own_x", "least", "query_low", "query_high", "floor", "longest", "found"]

    def out(uids, ids, x, c):
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(block(uids, ids, x, c), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, held = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in (0, 1)] + [matrix(batch.column(2)), batch.column(3).to_numpy()]
            held = part if held is None else [np.concatenate(p) for p in zip(held, part, strict=True)]
            while len(held[0]) and (held[3][0] != held[3][-1] or len(held[0]) > size):
                n = min(int(np.searchsorted(held[3], held[3][0], "right")), size)
                yield out(*(h[:n] for h in held[:3]), c)
                c, held = c + 1, [h[n:] for h in held]
        if held is not None and len(held[0]):
            yield out(*held[:3], c)
    return run


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in batch.column(0):
            rows = np.frombuffer(found.as_buffer(), _HIT)
            yield pa.RecordBatch.from_arrays([pa.array(rows[n].copy()) for n in _HIT.names], list(_HIT.names))


def _search(dim: int, pivots: np.ndarray, reach: float, k: int):
    """Rows by block: first the block itself, then the queries that visit it, of which one pack is held at a time."""
    kinds = (np.int64, np.int64, np.float64, np.float32, np.int64, np.int64, np.float64, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = []
            for row in range(len(batch)):
                data = [np.frombuffer(v.as_buffer(), t) if (v := batch.column(i)[row]).is_valid else None for i, t in enumerate(kinds)]
                if data[0] is not None:
                    held = [d.copy() for d in data[:4]]   # outlives its batch
                    continue
                uids, ids, x, table = held
                own_uids, own_ids, own_x, least = data[4:]
                mine = own_x.reshape(-1, dim)
                to_pivots, longest = distances(as_queries(mine), pivots), (mine ** 2).sum(axis=1)
                points, queries = exact(x.reshape(-1, dim), mine)
                for q in range(len(own_uids)):
                    hit = search_block(uids, ids, points, table.reshape(len(ids), -1), queries[q], own_uids[q], longest[q], to_pivots[q], reach, k, least[q])
                    rows += [(own_uids[q], own_ids[q], i, int(s)) for i, s in zip(*hit, strict=True)]
            told = np.array(rows, _HIT)
            yield pa.RecordBatch.from_arrays([pa.array(told[n].copy()) for n in _HIT.names], list(_HIT.names))
    return run


def _can_meet(reach: float) -> Column:
    """Whether some query of the left block may find something in the right one: their ranges of pivot distances are close enough."""
    apart = F.zip_with(F.arrays_zip("query_low", "query_high"), F.arrays_zip("low", "high"), lambda q, c: F.greatest(
        c["low"] - q["query_high"], q["query_low"] - c["high"], F.lit(0.0)))
    gap = F.greatest(F.array_max(apart) - 2 * slack(reach), F.lit(0.0))
    return upper(F.col("longest"), reach, gap) >= F.col("floor")


def _top_k(rows: DataFrame, n: int, reach: float, dim: int, k: int, step: int) -> DataFrame:
    pivots = choose_pivots(lifted(sample(rows, PIVOT_SAMPLE), reach), PIVOTS)
    parts = max(-(-n // (8 * BLOCK)), min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // BLOCK)))
    placed = stored(rows.mapInArrow(_cells(pivots, reach), "uid bigint, vec_id bigint, v array<double>, cell int, away double"))
    order = ["cell", "away", "uid"]   # copies of one vector are told apart by their number, so they spread over blocks
    blocks = stored(placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("uid", "vec_id", "v", "cell")
                    .mapInArrow(_blocks(pivots, reach, k, step, BLOCK), BLOCKS))
    hits = blocks.select("found").mapInArrow(_told, HITS)
    # Every query block against every block, as small rows of ranges; only pairs that can meet travel with their vectors.
    asking = blocks.where(F.octet_length("own_ids") > 0).select(F.col("c").alias("q"), "query_low", "query_high", "floor", "longest")
    pairs = stored(asking.withColumn("one", F.lit(1)).join(blocks.select("c", "low", "high").withColumn("one", F.lit(1)), "one")
                   .where((F.col("q") != F.col("c")) & _can_meet(reach)).select("q", "c"))
    # A block goes to one task, once, and the queries that visit it, a twentieth of their blocks, come to it.
    visited = blocks.join(pairs.select("c").distinct(), "c", "left_semi").select("c", F.lit(None).cast("bigint").alias("q"), "uids", "ids", "x", "table")
    visits = pairs.join(blocks.select(F.col("c").alias("q"), "own_uids", "own_ids", "own_x", "least"), "q")
    met = visited.unionByName(visits, allowMissingColumns=True).repartition(max(1, -(-n // BLOCK)), "c").sortWithinPartitions("c", F.asc_nulls_first("q"))
    return hits.unionByName(met.select("uids", "ids", "x", "table", "own_uids", "own_ids", "own_x", "least").mapInArrow(_search(dim, pivots, reach, k), HITS))


def top_k(table: DataFrame, vector: str = "embedding", k: int = 20, step: int = QUERY_STEP, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` highest inner products of floor(scale * x).

    Queries are the rows whose vec_id is divisible by ``step``; candidates are all other rows of
    their vector length.  Rows are dealt by their nearest pivot (a bounded sample picks the
    pivots) and their distance to it, cut into blocks of neighbours, and every block carries its table of distances.
    A query is first searched in its own block; its k-th score there goes with it.  Another
    block is visited only if the ranges of the two blocks' pivot distances leave room for a better score, and
    in a block candidates are computed in the order of their own bounds until none can enter.

    Defined cases: ``vectors.valid`` says which rows take part (no null, empty or non-finite
    vectors); of one vec_id every different vector is a row, equal ones count once, and each
    is a query of its own; ties go to the smaller vec_id; fewer candidates than ``k`` are
    all returned; an empty table gives an empty result; other columns are not read.  Scores are
    exact whole numbers; one beyond 64 bits is an error.
    """
    rows = valid(table, vector, lambda x: F.floor(x * scale).cast("double"), zeros=True)
    hits = None
    for part, n, reach, dim in by_length(rows, step):
        more = _top_k(part, n, reach, dim, k, step)
        hits = more if hits is None else hits.unionByName(more)
    return best(table.sparkSession.createDataFrame([], HITS) if hits is None else hits, k)
