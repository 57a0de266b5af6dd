"""Chat formatting: the cheapest repair of a turn sequence, then its rendering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

ROLES = ("system", "user", "assistant")
START, OTHER = 0, 0
# A conversation: at most one system turn first, then user and assistant in turn, ending with the assistant.
NEXT = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
LAST = 3
MERGE, INSERT, RELABEL = 1, 2, 3
NEVER = 1 << 40
OPEN, CLOSE, JOINT = "<|im_start|>{}\n", "<|im_end|>\n", "\n"
# Conversations of more turns are cut into chunks, which meet through small matrices.
LONG = 10_000
OUTPUT = ("conv_id {0}, turn {1}, place bigint, action string, role string, inserted string, cost int, piece string")


def _inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each state and next role the shortest run of empty turns that makes the role legal."""
    found = {}
    for state, role in product(NEXT, (1, 2, 3)):
        for n in range(4):
            runs = [r for r in product((1, 2, 3), repeat=n)
                    if all(b in NEXT[a] for a, b in zip((state, *r), (*r, role), strict=True))]
            if runs:
                found[state, role] = runs[0]
                break
    return found


INSERTS = _inserts()
ENDS = {state: (() if state == LAST else (*INSERTS[state, LAST], LAST)) for state in NEXT}


def _step(kind: int, state: int, new: int) -> tuple[int, str, tuple[int, ...]]:
    """Cost, action and inserted roles of taking a turn of role ``kind`` (0: unknown) into state ``new``."""
    relabel = RELABEL * (kind != new)
    ways = [(relabel + INSERT * len(r), "relabel" if relabel else "keep", r) for r in [INSERTS.get((state, new))] if r is not None]
    if state == new:
        ways.append((relabel + MERGE, "relabel+merge" if relabel else "merge", ()))
    return min(ways, key=lambda w: w[0], default=(NEVER, "", ()))


STEPS = {(k, s, n): _step(k, s, n) for k in range(4) for s in NEXT for n in NEXT if n != START}
COSTS = np.array([[[STEPS[k, s, n][0] if n else NEVER for n in range(4)] for s in range(4)] for k in range(4)], np.int64)
END_COSTS = np.array([INSERT * len(ENDS[s]) for s in range(4)], np.int64)


def kind_of(role) -> int:
    return ROLES.index(role) + 1 if role in ROLES else OTHER


BEGIN = np.array([0, NEVER, NEVER, NEVER], np.int64)


def path(kinds) -> list[int]:
    """States after each turn on a cheapest way from the start to the end.

    Of equally cheap ways the one with the smaller state at the latest turn where they differ.
    """
    return _path(bytes(kinds)) if len(kinds) <= 64 else _whole_path(kinds)


def _whole_path(kinds) -> list[int]:
    back, best = forward(kinds, BEGIN)
    return backward(back, int((best + END_COSTS).argmin()))[1]


@lru_cache(maxsize=50_000)
def _path(kinds: bytes) -> list[int]:
    return _whole_path(kinds)


def forward(kinds, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(state before each turn for every state after it, least costs after the last turn), from the least costs before the first."""
    back = np.empty((len(kinds), 4), np.int8)
    for i, kind in enumerate(kinds):
        ways = best[:, None] + COSTS[kind]
        back[i] = ways.argmin(axis=0)
        best = ways.min(axis=0)
    return back, best


def backward(back: np.ndarray, state: int) -> tuple[int, list[int]]:
    """(state before the first turn, states after each turn) on the way that ends in ``state``."""
    states = []
    for row in back[::-1]:
        states.append(state)
        state = int(row[state])
    return state, states[::-1]


def matrix(kinds) -> np.ndarray:
    """Cheapest cost from each state before the turns to each state after them."""
    out = np.full((4, 4), NEVER, np.int64)
    np.fill_diagonal(out, 0)
    for kind in kinds:
        out = np.minimum((out[:, :, None] + COSTS[kind][None]).min(axis=1), NEVER)
    return out


def _safe(text) -> str:
    return (text or "").replace("<|im_start|>", "<|im_start |>").replace("<|im_end|>", "<|im_end |>")


def rows_of(conv, turns, roles, texts, states: list[int], entry: int = START, ends: bool = True, first: int = 0) -> list[tuple]:
    """One output row per turn; the pieces of a conversation, one after the other, are its rendering."""
    out, state = [], entry
    for i, (turn, role, text, new) in enumerate(zip(turns, roles, texts, states, strict=True)):
        cost, action, empty = STEPS[kind_of(role), state, new]
        blank = "".join(OPEN.format(ROLES[r - 1]) + CLOSE for r in empty)
        if action.endswith("merge"):
            piece = JOINT + _safe(text)
        else:
            piece = CLOSE * (state != START) + blank + OPEN.format(ROLES[new - 1]) + _safe(text)
        inserted = [ROLES[r - 1] for r in empty]
        if ends and i == len(states) - 1:
            tail = ENDS[new]
            piece += CLOSE + "".join(OPEN.format(ROLES[r - 1]) + CLOSE for r in tail)
            cost += INSERT * len(tail)
            inserted += [f"{ROLES[r - 1]}(end)" for r in tail]
        out.append((conv, turn, first + i, action, ROLES[new - 1], ",".join(inserted), cost, piece))
        state = new
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _output(keys: tuple[pa.DataType, pa.DataType]) -> pa.Schema:
    kinds = (*keys, pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())
    return pa.schema(list(zip(("conv_id", "turn", "place", "action", "role", "inserted", "cost", "piece"), kinds, strict=True)))


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in sorted order, each with all its turns in this partition."""
    held, key, out, size, schema = [], object(), [], 0, None

    def finish():
        turns, roles, texts = zip(*held, strict=True)
        return rows_of(key, turns, roles, texts, path([kind_of(r) for r in roles]))
    for batch in batches:
        schema = schema or _output((batch.schema.field(0).type, batch.schema.field(1).type))
        for conv, *turn in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != key:
                out += finish()
                held = []
                if size > 4_000_000:
                    yield _batch(out, schema)
                    out, size = [], 0
            key = conv
            held.append(turn)
            size += len(turn[2] or "") + 100
    if held:
        yield _batch(out + finish(), schema)


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds chunk (rising along the sorted rows) and pos; a chunk holds LONG turns of one conversation at most."""
    chunk, pos, key = TaskContext.get().partitionId() << 32, 0, object()
    for batch in batches:
        chunks, places = [], []
        for conv in batch.column(0).to_pylist():
            if (pos and conv != key) or pos == LONG:
                chunk, pos = chunk + 1, 0
            key = conv
            chunks.append(chunk)
            places.append(pos)
            pos += 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chunks, pa.int64()), pa.array(places, pa.int64())],
                                         [*batch.schema.names, "chunk", "pos"])


def _summaries(group: pa.Table) -> pa.Table:
    group = group.sort_by("pos")
    found = matrix([kind_of(r) for r in group["role"].to_pylist()])
    return pa.table({"conv_id": group["conv_id"].slice(0, 1), "chunk": group["chunk"].slice(0, 1), "turns": [len(group)],
                     "costs": pa.array([found.ravel().tolist()], pa.list_(pa.int64()))})


def _entered(chunks: pd.DataFrame) -> pd.DataFrame:
    """Per chunk of one conversation the least costs of the states before it, where it begins, and whether it is the last."""
    chunks = chunks.sort_values("chunk")
    best, costs = BEGIN, []
    for c in chunks["costs"]:
        costs.append(best.tolist())
        best = np.minimum((best[:, None] + np.array(c, np.int64).reshape(4, 4)).min(axis=0), NEVER)
    turns = chunks["turns"].to_numpy()
    return pd.DataFrame({"chunk": chunks["chunk"], "before": costs, "first": np.cumsum(turns) - turns, "final": [False] * (len(turns) - 1) + [True]})


def _traced(group: pa.Table) -> pa.Table:
    """One row per chunk: for every state after it the state before it on the way of the whole conversation."""
    group = group.sort_by("pos")
    back, best = forward([kind_of(r) for r in group["role"].to_pylist()], np.array(group["before"][0].as_py(), np.int64))
    last = int((best + END_COSTS).argmin()) if group["final"][0].as_py() else None
    return pa.table({"conv_id": group["conv_id"].slice(0, 1), "chunk": group["chunk"].slice(0, 1), "last": pa.array([last], pa.int32()),
                     "entries": pa.array([[backward(back, s)[0] for s in range(4)]], pa.list_(pa.int32()))})


def _left(chunks: pd.DataFrame) -> pd.DataFrame:
    """Per chunk of one conversation the state in which the way leaves it, from the right."""
    chunks = chunks.sort_values("chunk", ascending=False)
    state, leaves = int(chunks["last"].iloc[0]), []
    for entries in chunks["entries"]:
        leaves.append(state)
        state = int(entries[state])
    return pd.DataFrame({"chunk": chunks["chunk"], "leave": leaves})


def _pieces(group: pa.Table) -> pa.Table:
    group = group.sort_by("pos")
    roles = group["role"].to_pylist()
    before, leave, first, final = (group[n][0].as_py() for n in ("before", "leave", "first", "final"))
    entry, states = backward(forward([kind_of(r) for r in roles], np.array(before, np.int64))[0], leave)
    rows = rows_of(group["conv_id"][0].as_py(), group["turn"].to_pylist(), roles, group["text"].to_pylist(), states, entry, final, first)
    return pa.Table.from_batches([_batch(rows, _output((group.schema.field("conv_id").type, group.schema.field("turn").type)))])


def repair(turns: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, turn, place, action, role, inserted, cost, piece: one row per turn of ``turns``.

    Dynamic programming over the legal-turn automaton: each turn is kept, relabelled, merged into
    the turn before it, or preceded by empty turns, at the least total cost per conversation.  The
    pieces in the order of ``place`` are the rendered conversation; template marks inside texts
    are broken by a blank.

    Conversations up to ``long`` turns are solved in one go.  Longer ones are range-partitioned
    along their turns; a chunk is a 4 x 4 matrix of costs between states, and the matrices of one
    conversation are chained (one small row per chunk), which tells the least costs before every
    chunk.  From these each chunk says which state its best ways to the four states after it come
    from; that table is chained from the right.  The rows are the same for every ``long``, ties included.

    Defined cases: turns are taken in the order of turn (null first), role, text; a null or
    unknown role costs a relabel whatever it becomes; a null text is empty; a null conv_id is a
    conversation of its own; repeated rows are repeated turns; an empty table gives no row;
    other columns do not come along.
    """
    rows = turns.select("conv_id", "turn", "role", "text")
    kinds = [turns.schema[n].dataType.simpleString() for n in ("conv_id", "turn")]
    schema = OUTPUT.format(*kinds)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long).select(F.col("conv_id").alias("c"), "n")
    sizes = stored(sizes)
    same: Column = rows["conv_id"].eqNullSafe(sizes["c"])
    order = ["conv_id", "turn", "role", "text"]
    short = (rows.join(sizes, same, "left_anti").repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_whole, schema))
    total = sizes.agg(F.sum("n")).first()[0]
    if not total:
        return short
    hot = rows.withColumn("__n", F.monotonically_increasing_id()).join(sizes.select("c"), same, "left_semi")
    chunked = stored(hot.repartitionByRange(-(-total // long), *order, "__n").sortWithinPartitions(*order, "__n").drop("__n")
                     .mapInArrow(_chunked, f"conv_id {kinds[0]}, turn {kinds[1]}, role string, text string, chunk bigint, pos bigint"))
    entered = stored(chunked.select("conv_id", "chunk", "pos", "role").groupBy("chunk")
                     .applyInArrow(_summaries, f"conv_id {kinds[0]}, chunk bigint, turns bigint, costs array<bigint>")
                     .groupBy("conv_id").applyInPandas(_entered, "chunk bigint, before array<bigint>, first bigint, final boolean"))
    known = chunked.join(entered, "chunk")
    left = stored(known.select("conv_id", "chunk", "pos", "role", "before", "final").groupBy("chunk")
                  .applyInArrow(_traced, f"conv_id {kinds[0]}, chunk bigint, last int, entries array<int>")
                  .groupBy("conv_id").applyInPandas(_left, "chunk bigint, leave int"))
    return short.unionByName(known.join(left, "chunk").groupBy("chunk").applyInArrow(_pieces, schema))
