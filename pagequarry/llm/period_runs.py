"""Periodic run detection: branching tandem repeats of an enhanced suffix array, merged into runs of words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import without
from pagequarry.session import spread

MIN_WORDS, MIN_POWER = 24, 3
# Words of documents that share one suffix array (a longer document has one of its own).
BATCH_WORDS = 200_000
ADDED = "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def planted_cycle(doc_id, n: int) -> np.ndarray | None:
    """Word numbers of the contract's periodic documents, or None where a document stays as it is."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


# --- what cannot hold a run is left out of the suffix array ---------------------------------------------

def _grams(x: np.ndarray, n: int) -> np.ndarray:
    """A hash of the words i .. i+n-1 for every i; equal grams have equal hashes."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        base, size = np.uint64(0xD6E8FEB86659FD93), 1
        while size < n:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
    return h


def suspects(words: list[np.ndarray], least: int = MIN_WORDS, power: int = MIN_POWER) -> list[int]:
    """The documents in which some gram of g words occurs twice, g being the power of two that every run repeats.

    A run of period q and max(least, power * q) words agrees with itself q words on in at least
    max(least - q, (power - 1) * q) words, which is least * (power - 1) / power or more for every q.
    """
    must = least * (power - 1) // power
    gram = 1 << (must.bit_length() - 1)
    out = []
    for i, w in enumerate(words):
        if len(w) >= least:
            grams = np.sort(_grams(w, gram))
            if (grams[1:] == grams[:-1]).any():
                out.append(i)
    return out


# --- enhanced suffix array ----------------------------------------------------------------------------

class SuffixArray:
    """Suffix array, its inverse and the LCPs of neighbours, by prefix doubling.

    ``levels[j]`` ranks the substrings of 2^j letters, so that two substrings are compared by two
    lookups and the LCP of two suffixes is found in one step per level.
    """

    def __init__(self, x: np.ndarray):
        n = len(x)
        _, first = np.unique(x, return_inverse=True)
        self.levels = [first.astype(np.int32)]
        size = 1
        while True:
            rank = self.levels[-1].astype(np.int64)
            after = np.zeros(n, np.int64)
            after[:n - size] = rank[size:] + 1
            key = rank * (n + 1) + after
            self.sa = np.argsort(key)
            key = key[self.sa]
            new = np.empty(n, np.int32)
            new[self.sa] = np.concatenate(([0], np.cumsum(key[1:] != key[:-1], dtype=np.int32)))
            self.levels.append(new)
            size *= 2
            if size >= n or new[self.sa[-1]] == n - 1:
                break
        self.isa = self.levels[-1]
        self.n = n

    def lcp(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j (different ones)."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            a, b = i + out, j + out
            inside = np.maximum(a, b) + (1 << k) <= self.n
            level = self.levels[k]
            same = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
            out += same.astype(np.int64) << k
        return out

    def equal(self, i: np.ndarray, j: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` letters from i equal those from j; both lie inside."""
        out = np.ones(len(i), bool)
        power = np.frexp(length.astype(float))[1] - 1
        for k in np.unique(power):
            at = power == k
            level, shift = self.levels[min(k, len(self.levels) - 1)], length[at] - (1 << k)
            out[at] = (level[i[at]] == level[j[at]]) & (level[i[at] + shift] == level[j[at] + shift])
        return out


def _sides(lcp: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every p: where its LCP interval starts left of p and ends right of p (in positions of the suffix array).

    Equal values count as smaller on the left and as not smaller on the right, which splits an
    interval with several children into pairs of neighbours, each pair of children in one split.
    """
    n = len(lcp)
    left, right, stack = [0] * n, [n] * n, []
    for p in range(1, n):
        value = lcp[p]
        while stack and lcp[stack[-1]] > value:
            right[stack.pop()] = p
        left[p] = stack[-1] if stack else 0
        stack.append(p)
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_tandems(index: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of every square w w whose next letter breaks the period.

    Each LCP interval of depth q is split between its children; the suffixes i of the smaller side
    look up ISA[i + q] and ISA[i - q] on the other side.
    """
    sa, isa, n = index.sa, index.isa, index.n
    lcp = np.concatenate(([0], index.lcp(sa[:-1], sa[1:])))
    left, right = _sides(lcp.tolist())
    p = np.flatnonzero(lcp > 0)
    low, high, depth = left[p], right[p], lcp[p]
    small_left = p - low <= high - p
    begin, size = np.where(small_left, low, p), np.where(small_left, p - low, high - p)
    other, other_end = np.where(small_left, p, low), np.where(small_left, high, p)
    starts, periods = [], []
    # The number of lookups is n log n at most; they go in blocks of bounded size.
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // 4_000_000, prepend=-1)) if len(p) else np.zeros(0, np.int64)
    for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True):
        n_each = size[a:b]
        which = np.repeat(np.arange(a, b), n_each)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n_each) - n_each, n_each)
        i, q = sa[begin[which] + offset], depth[which]
        for step, start in ((q, i), (-q, i - q)):
            j = i + step
            inside = (j >= 0) & (j < n)
            rank = isa[np.where(inside, j, 0)]
            hit = inside & (rank >= other[which]) & (rank < other_end[which])
            starts.append(start[hit])
            periods.append(q[hit])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(periods)


def runs_of(x: np.ndarray, least: int = MIN_WORDS, power: int = MIN_POWER) -> list[tuple[int, int, int]]:
    """(start, length, period) of every maximal stretch of smallest period q and length >= max(least, power * q).

    A run ends with one branching square.  It is kept if the words before the square go on with the
    period as far as a run must reach, rotated left to the start of the run, and merged with
    the squares of multiples of its period.
    """
    if len(x) < max(2, least):
        return []
    index = SuffixArray(x)
    start, q = branching_tandems(index)
    need = np.maximum(least, power * q) - 2 * q
    at = start - need
    room = at >= 0
    start, q, at, need = start[room], q[room], at[room], need[room]
    kept = index.equal(at, at + q, need + q)
    found: dict[int, list[tuple[int, int]]] = {}
    out = []
    order = np.lexsort((start[kept], q[kept]))
    for s, period, sure in zip(start[kept][order].tolist(), q[kept][order].tolist(), at[kept][order].tolist(), strict=True):
        end = s + 2 * period
        if any(period % known == 0 and first <= sure for first, known in found.get(end, ())):
            continue
        first = _rotated(x, sure, period)
        found.setdefault(end, []).append((first, period))
        out.append((first, end - first, period))
    return sorted(set(out), key=lambda r: (r[0], r[2]))


def _rotated(x: np.ndarray, at: int, period: int) -> int:
    """The first word from which the period holds up to ``at``."""
    step = 64
    while at:
        low = max(0, at - step)
        broken = np.flatnonzero(x[low:at] != x[low + period:at + period])
        if len(broken):
            return low + int(broken[-1]) + 1
        at, step = low, step * 2
    return 0


def runs_of_all(words: list[np.ndarray], least: int = MIN_WORDS, power: int = MIN_POWER) -> list[list[tuple[int, int, int]]]:
    """:func:`runs_of` of many documents; suspect ones share suffix arrays, parted by letters that occur once."""
    out: list[list] = [[] for _ in words]
    group, size = [], 0

    def solve():
        top = max(int(words[i].max()) for i in group) + 1
        joined = np.concatenate([np.append(words[i], top + k) for k, i in enumerate(group)])
        ends = np.cumsum([len(words[i]) + 1 for i in group])
        for start, length, period in runs_of(joined, least, power):
            k = int(np.searchsorted(ends, start, "right"))
            out[group[k]].append((start - int(ends[k] - len(words[group[k]]) - 1), length, period))
    for i in suspects(words, least, power):
        if group and size + len(words[i]) > BATCH_WORDS:
            solve()
            group, size = [], 0
        group.append(i)
        size += len(words[i])
    if group:
        solve()
    return out


def dropped(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Marks the words after the first period of some run."""
    edges = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return np.cumsum(edges[:-1]) > 0


# --- the operator -----------------------------------------------------------------------------------

_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(least: int, power: int, cycles: bool):
    def solve(keys: pa.Array, texts: list) -> pa.RecordBatch:
        ids: dict[bytes, int] = {}
        split, words = [], []
        for key, text in zip(keys.to_pylist(), texts, strict=True):
            mine = (text or "").encode().split()   # exactly the six blanks, unlike str.split
            x = np.fromiter((ids.setdefault(w, len(ids)) for w in mine), np.int64, len(mine))
            cycle = planted_cycle(key, len(mine)) if cycles else None
            if cycle is not None:
                x, mine = x[cycle], [mine[i] for i in cycle.tolist()]
            split.append(mine)
            words.append(x)
        found = runs_of_all(words, least, power)
        kept = []
        for mine, runs in zip(split, found, strict=True):
            gone = dropped(len(mine), runs) if runs else ()
            kept.append(b" ".join([w for w, g in zip(mine, gone, strict=True) if not g] if runs else mine).decode())
        told = [[{"start": s, "length": n, "period": q} for s, n, q in runs] for runs in found]
        return pa.RecordBatch.from_arrays([pa.array([len(w) for w in words], pa.int64()), pa.array(told, _RUNS), pa.array(kept, pa.string())],
                                          ["n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = 0
            while first < len(batch):
                last, size, texts = first, 0, []
                while last < len(batch) and (not texts or size < 8_000_000):
                    texts.append(batch.column(1)[last].as_py())
                    size += len(texts[-1] or "") + 100
                    last += 1
                made = solve(batch.column(0).slice(first, last - first), texts)
                rest = [batch.column(c).slice(first, last - first) for c in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([*rest, *made.columns], [batch.schema.names[0], *batch.schema.names[2:], *made.schema.names])
                first = last
    return run


def periodic_runs(docs: DataFrame, least: int = MIN_WORDS, power: int = MIN_POWER, cycles: bool = False) -> DataFrame:
    """``docs`` with n_words, ``runs`` (start, length, period; by start, then period) and ``collapsed``.

    A run is a maximal stretch of words with smallest period q and at least max(``least``,
    ``power`` * q) words; ``collapsed`` are the words outside, and the first q words of, every run,
    joined by one blank.  An enhanced suffix array over the word numbers of a document gives the
    branching squares, which are rotated and merged into runs; documents in which no 16 words (for
    the standard bounds) occur twice cannot hold a run and stay out of it.  ``cycles`` makes the
    contract's share of documents periodic first.

    Defined cases: a null or blank text has no words, no run and an empty ``collapsed``; documents
    are solved each by itself in the task that reads them, so repeated rows, ties and empty tables need no rule; a
    null doc_id is never made periodic; a very long text takes a suffix array of its own (about 4 bytes
    a word and doubling step); other columns pass unchanged, but columns named like the added ones
    and ``text`` are replaced or left out.
    """
    rows = without(docs.select("*"), ("n_words", "runs", "collapsed"))
    others = [c for c in rows.columns if c not in ("doc_id", "text")]
    rows = spread(rows.select("doc_id", "text", *[F.col(f"`{c}`") for c in others]))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(_found(least, power, cycles), f"{', '.join(kept)}, {ADDED}")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the run of the greatest exponent, and hashes of all runs and of the collapsed text."""
    # length / period of two runs is compared exactly: cross products, ties to the smaller start and period.
    better = lambda a, b: F.when(
        a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return (found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")))
