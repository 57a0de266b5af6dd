"""Suffix-array dedup: repeated strings found through run-length Burrows-Wheeler indexes.

Equal strings of LENGTH bytes choose the same anchor (the smallest hash of SEED_BYTES bytes in
them), so every window, i.e. string of LENGTH bytes, belongs to one anchor and meets its equals
in the bucket of that anchor.  Buckets of one entry, and entries that are equal all through, are
settled by counting.  What is left are different contexts round the same anchor, where a repeat
begins or ends: these short, highly repetitive texts are dealt to shards.  A shard indexes the
earlier contexts of its buckets and streams the later ones through the run-compressed transform,
right to left; a window whose matching statistic reaches LENGTH starts earlier too.

A bucket of more than HOT contexts is dealt again by longer anchors: the bytes that BLOCK
neighbouring windows have in common.  A part then holds at most BLOCK - 1 free bytes on either
side, parts that are equal are counted away, and the rest takes the same way through the index.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

LENGTH, SEED_BYTES = 100, 32
SLICE = 1 << 20
SHARD_BYTES = 1 << 21
# Buckets of more contexts are dealt again by what BLOCK neighbouring windows have in common.
HOT, BLOCK = 8_000, 4
_RNG = np.random.default_rng(20)
_TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE, SLICE + 4 * LENGTH), _powers(_INVERSE, SLICE + 4 * LENGTH)


def _doubled(x: np.ndarray, width: int, join) -> np.ndarray:
    """Combine ``width`` neighbours (a power of two) in log steps; join(left, right, step)."""
    step = 1
    while step < width:
        x = join(x[:-step], x[step:], step)
        step *= 2
    return x


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the SEED_BYTES bytes from each place on."""
    return _mixed(_doubled(_TABLE[data], SEED_BYTES, lambda a, b, step: a * _UP[step] + b))


def spans(data: np.ndarray, limit: np.ndarray):
    """seed hash, context hash, first window and number of windows of every anchor of ``data``.

    ``limit[i]`` is the end of the text that place i lies in; windows never pass it.
    """
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    seeds = seed_hashes(data)
    # 40 bits of hash, then the place: the leftmost of equal seeds, a rule on content alone.
    keyed = (seeds & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(seeds), dtype=np.uint64)
    choices = LENGTH - SEED_BYTES + 1
    least = _doubled(keyed, 64, lambda a, b, step: np.minimum(a, b))
    least = np.minimum(least[:len(data) - LENGTH + 1], least[choices - 64:][:len(data) - LENGTH + 1])
    starts = np.flatnonzero(np.arange(LENGTH, len(data) + 1) <= limit[:len(data) - LENGTH + 1])
    anchors = (least[starts] & np.uint64(0xFFFFFF)).astype(np.int64)
    if not len(starts):
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    head = np.flatnonzero(np.concatenate([[True], (np.diff(anchors) != 0) | (np.diff(starts) != 1)]))
    first, anchor = starts[head], anchors[head]
    count = np.diff(np.concatenate([head, [len(starts)]]))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLE[data] * _UP[:len(data)], dtype=np.uint64)])
    context = (sums[first + count + LENGTH - 1] - sums[first]) * _DOWN[first]
    shape = ((anchor - first) * 256 + count).astype(np.uint64)
    return seeds[anchor], _mixed(context + _mixed(shape * _BASE)), first, count


def _slices(texts: list[bytes]):
    """Concatenated texts of about SLICE bytes; a longer text comes in parts whose windows follow on.

    Yields data, limits, and for each byte its text and place of the slice's texts.
    """
    held, size = [], 0
    for i, text in enumerate(texts):
        step = SLICE - LENGTH
        for at in range(0, max(len(text) - LENGTH + 1, 1), step):
            part = text[at:at + step + LENGTH - 1]
            if size + len(part) > SLICE and held:
                yield held
                held, size = [], 0
            held.append((i, at, part))
            size += len(part)
    if held:
        yield held


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """first: windows of the least occurrence of each context in a slice; the others are repeats."""
    for batch in batches:
        docs, rows, texts = batch.column(0), batch.column(1).to_numpy(), [t or b"" for t in batch.column(2).to_pylist()]
        order = docs.fill_null(np.iinfo(np.int64).min).to_numpy()
        for held in _slices(texts):
            data = np.frombuffer(b"".join(p for _, _, p in held), np.uint8)
            lengths = np.array([len(p) for _, _, p in held])
            ends = np.cumsum(lengths)
            seeds, contexts, first, count = spans(data, np.repeat(ends, lengths))
            part = np.searchsorted(ends, first, side="right")
            text = np.array([i for i, _, _ in held])[part]
            at = np.array([a for _, a, _ in held])[part] + first - (ends - lengths)[part]
            # Equal contexts of this slice meet here already.
            sort = np.lexsort((at, rows[text], order[text], contexts, seeds))
            lead = np.ones(len(sort), bool)
            lead[1:] = (seeds[sort][1:] != seeds[sort][:-1]) | (contexts[sort][1:] != contexts[sort][:-1])
            repeat = np.empty(len(sort), bool)
            repeat[sort] = ~lead
            yield pa.RecordBatch.from_arrays([
                pa.array(repeat), pa.array(seeds.view(np.int64)), pa.array(contexts.view(np.int64)), docs.take(pa.array(text)),
                pa.array(rows[text]), pa.array(at), pa.array(count.astype(np.int32))],
                ["repeat", "seed", "context", "doc_id", "row", "at", "windows"])


# --- the run-length index ------------------------------------------------------------------

@dataclass
class RunIndex:
    """A run-compressed Burrows-Wheeler transform of contexts, with suffix samples at both ends of a run.

    Runs are held by symbol, then by place in the transform.  Contexts of different ``blocks`` have
    different symbols, so one index holds many that know nothing of each other.
    """

    words: np.ndarray    # the eight bytes from each place of the indexed text on
    left: np.ndarray     # bytes from each place to the end of its context
    size: int            # rows of the transform
    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    targets: np.ndarray  # row of the suffix that a run's first row leads to, one symbol further left
    heads: np.ndarray    # suffix of a run's first row
    tails: np.ndarray    # suffix of its last row


@dataclass
class Contexts:
    """Contexts one after the other, a zero byte behind each."""

    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    @classmethod
    def of(cls, parts: list[bytes]) -> Contexts:
        lengths = np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        return cls(np.frombuffer(b"\0".join(parts) + b"\0", np.uint8), ends - lengths, ends)

    def per_place(self, values: np.ndarray) -> np.ndarray:
        return np.repeat(values, self.ends - self.begins + 1)


def byte_words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, the first byte lowest."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(data), np.uint64)
    for j in range(8):
        out |= padded[j:j + len(data)] << np.uint64(8 * j)
    return out


def suffix_order(data: np.ndarray, left: np.ndarray, block: np.ndarray) -> np.ndarray:
    """Suffixes by block, then in order, each up to the end of its context (``left`` bytes), equal ones by place."""
    n = len(data)
    symbols = np.concatenate([data.astype(np.uint64) + np.uint64(1), np.zeros(8, np.uint64)])
    key = block.astype(np.uint64)
    depth, most = 6 if int(block.max(initial=0)) < 1 << 10 else 5, int(left.max(initial=0))
    for j in range(depth):
        key = (key << np.uint64(9)) | np.where(left > j, symbols[j:j + n], 0).astype(np.uint64)
    while True:
        order = np.argsort(key, kind="stable" if depth >= most else None)
        fresh = np.concatenate([[False], np.diff(key[order]) != 0])
        rank = np.empty(n, np.uint64)
        rank[order] = np.cumsum(fresh) + 1
        if depth >= most or int(rank[order[-1]]) == n:
            return order
        after = np.concatenate([rank, np.zeros(depth, np.uint64)])[depth:depth + n]
        key = (rank << np.uint64(32)) | np.where(left > depth, after, 0).astype(np.uint64)
        depth *= 2


def build(texts: Contexts, block: np.ndarray) -> RunIndex:
    """Index of contexts; ``block`` of each keeps it apart from those of other blocks."""
    place_block = texts.per_place(block)
    left = texts.per_place(texts.ends) - np.arange(len(texts.data))
    order = suffix_order(texts.data, left, place_block)
    # The symbol before a context's first byte is its block's end mark, below all bytes; no text holds it.
    before = np.concatenate([[0], texts.data[:-1].astype(np.int64) + 1])
    before[texts.begins] = 0
    before = (before + 257 * place_block)[order]
    starts = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
    lengths = np.diff(np.concatenate([starts, [len(order)]]))
    by_symbol = np.argsort(before[starts], kind="stable")
    symbols, starts, lengths = before[starts][by_symbol], starts[by_symbol], lengths[by_symbol]
    return RunIndex(byte_words(texts.data), left, len(order), symbols, starts, lengths, np.cumsum(lengths) - lengths,
                    order[starts], order[starts + lengths - 1])


def _agreeing(index: RunIndex, suffix: np.ndarray, words: np.ndarray, at: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Equal bytes from indexed places ``suffix`` and streamed places ``at`` on, ``most`` at most."""
    most = np.minimum(most, index.left[suffix])
    out = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        differing = index.words[suffix[live] + out[live]] ^ words[at[live] + out[live]]
        lowest = differing & (~differing + np.uint64(1))
        out[live] += np.where(differing == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        live = live[(differing == 0) & (out[live] < most[live])]
    return np.minimum(out, most)


def matching_statistics(index: RunIndex, texts: Contexts, block: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """source, length per place of ``texts``: the longest match with the index that starts there, and where.

    All texts are streamed side by side, a byte a step.  If the byte stands before the suffix at
    hand, its row leads on; if not, the nearest run ends of that byte above and below are tried by
    their samples.  A text is left when no match of ``least`` bytes can come any more, with zeros
    for what is left of it.
    """
    source, length = np.zeros(len(texts.data), np.int64), np.zeros(len(texts.data), np.int64)
    words, last = byte_words(texts.data), len(index.symbols) - 1
    keys = index.symbols * (index.size + 1) + index.starts
    at, begin, base = texts.ends.copy(), texts.begins, 257 * block
    row, match = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    found = np.full(len(at), index.heads[np.argmin(index.starts)], np.int64)
    while True:
        live = (at > begin) & (at + match - begin >= least)
        if not live.all():
            at, begin, base, row, match, found = (x[live] for x in (at, begin, base, row, match, found))
        if not len(at):
            return source, length
        at = at - 1
        symbol = texts.data[at].astype(np.int64) + 1 + base
        below = np.searchsorted(keys, symbol * (index.size + 1) + row, side="right")
        above, below = np.maximum(below - 1, 0), np.minimum(below, last)
        is_above = (index.symbols[above] == symbol) & (index.starts[above] <= row)
        into = row - index.starts[above]
        inside = is_above & (into < index.lengths[above])
        row = np.where(inside, index.targets[above] + into, row)
        match, found = np.where(inside, match + 1, match), np.where(inside, found - 1, found)
        out = np.flatnonzero(~inside)
        if len(out):
            above, below, reach, place = above[out], below[out], match[out], at[out] + 1
            is_below = (index.symbols[below] == symbol[out]) & (index.starts[below] > row[out])
            up = np.where(is_above[out], _agreeing(index, index.tails[above], words, place, reach), -1)
            down = np.where(is_below, _agreeing(index, index.heads[below], words, place, reach), -1)
            upward = up >= down
            match[out] = np.maximum(up, down) + 1
            lost = match[out] == 0
            found[out] = np.where(lost, found[out], np.where(upward, index.tails[above], index.heads[below]) - 1)
            row[out] = np.where(lost, row[out], np.where(
                upward, index.targets[above] + index.lengths[above] - 1, index.targets[below]))
        source[at], length[at] = found, match


def repeated(parts: list[bytes], bucket: np.ndarray) -> list[np.ndarray]:
    """Windows of each context that an earlier context of its bucket holds too; a bucket's contexts follow each other.

    No context holds a window twice (both would have the same anchor).  Rounds of doubling span:
    the first half of each span of contexts is indexed, the second half is streamed through it.
    Contexts without an open window stay out, so that copies are indexed once.
    """
    n = len(parts)
    first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])[:n])
    group = np.repeat(np.arange(len(first)), np.diff(np.concatenate([first, [n]])))
    rank = np.arange(n) - first[group]
    marks = [np.zeros(len(p) - LENGTH + 1, bool) for p in parts]
    is_open, span, most = np.ones(n, bool), 1, int(rank.max(initial=0))
    while span <= most:
        block, late = rank // (2 * span), rank // span % 2 == 1
        pair = group * (most + 1) + block
        early = np.flatnonzero(is_open & ~late & np.isin(pair, pair[is_open & late]))
        later = np.flatnonzero(is_open & late & np.isin(pair, pair[early]))
        if len(later):
            texts = Contexts.of([parts[i] for i in later])
            _, length = matching_statistics(build(Contexts.of([parts[i] for i in early]), block[early]), texts, block[later], LENGTH)
            for i, begin in zip(later, texts.begins, strict=True):
                marks[i] |= length[begin:begin + len(marks[i])] >= LENGTH
                is_open[i] = not marks[i].all()
        span *= 2
    return marks


def _indexed(group: pa.Table) -> pa.Table:
    """Repeats within one shard: row, at, windows of each run of repeated windows."""
    group = group.sort_by([(c, "ascending") for c in ("seed", "doc_order", "row", "at")])
    marks = repeated(group["bytes"].to_pylist(), group["seed"].to_numpy())
    lengths = np.array([len(m) for m in marks])
    begins = np.cumsum(lengths) - lengths
    places = np.flatnonzero(np.concatenate(marks))
    head = np.concatenate([[True], np.diff(places) != 1])[:len(places)]
    head |= np.isin(places, begins)
    first = places[head]
    count = np.diff(np.concatenate([np.flatnonzero(head), [len(places)]]))
    part = np.searchsorted(begins, first, side="right") - 1
    return pa.table({"row": group["row"].take(pa.array(part)), "at": group["at"].to_numpy()[part] + first - begins[part],
                     "windows": pa.array(count.astype(np.int32))})


def _parted(context: bytes, seed: int) -> Iterator[tuple[int, int, bytes]]:
    """seed, first window and bytes of the parts of a hot context: BLOCK neighbouring places of the anchor in a window."""
    windows = len(context) - LENGTH + 1
    anchor = int(np.argmax(seed_hashes(np.frombuffer(context, np.uint8)).view(np.int64) == seed))
    for block in range((anchor - windows + 1) // BLOCK, anchor // BLOCK + 1):
        low, high = max(anchor - block * BLOCK - BLOCK + 1, 0), min(anchor - block * BLOCK, windows - 1)
        shared = context[anchor - block * BLOCK:anchor - block * BLOCK - BLOCK + 1 + LENGTH]
        longer = hashlib.blake2b(shared, digest_size=8, person=b"%d" % block).digest()
        yield int.from_bytes(longer, "little", signed=True), low, context[low:high + LENGTH]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each wanted context, cut from the texts that hold them; hot ones in parts."""
    held: list[tuple] = []

    def emitted() -> pa.RecordBatch:
        types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)],
                                          ["seed", "hot", "doc_order", "row", "at", "bytes"])

    for batch in batches:
        docs, rows, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)
        bounds = lists.offsets.to_pylist()
        for i, (doc, row) in enumerate(zip(docs, rows, strict=True)):
            text = batch.column(2)[i].as_buffer().to_pybytes()
            for first in range(bounds[i], bounds[i + 1], 20_000):
                some = lists.values.slice(first, min(20_000, bounds[i + 1] - first))
                for seed, at, windows, hot in zip(*(some.field(c).to_pylist() for c in ("seed", "at", "windows", "hot")), strict=True):
                    context = text[at:at + windows + LENGTH - 1]
                    if hot:
                        held.extend((part_seed, True, doc, row, at + low, part) for part_seed, low, part in _parted(context, seed))
                    else:
                        held.append((seed, False, doc, row, at, context))
                    if len(held) >= 20_000:
                        yield emitted()
                        held.clear()
    if held:
        yield emitted()


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text without the bytes of its marks, and its figures."""
    for batch in batches:
        texts, marks = batch.column(1), batch.column(2)
        bounds = marks.offsets.to_numpy()
        starts = marks.values.field("at").to_numpy(zero_copy_only=False)
        ends = starts + marks.values.field("windows").to_numpy(zero_copy_only=False) + (LENGTH - 1)
        kept, figures = [], np.zeros((3, len(batch)), np.int64)
        for i, text in enumerate(texts):
            data = np.frombuffer(text.as_buffer(), np.uint8) if text.is_valid else np.zeros(0, np.uint8)
            figures[0, i] = len(data)
            if bounds[i] == bounds[i + 1]:
                kept.append(data.tobytes())
                continue
            mine = slice(bounds[i], bounds[i + 1])
            gone = np.bincount(starts[mine], minlength=len(data) + 1) - np.bincount(ends[mine], minlength=len(data) + 1)
            gone = np.cumsum(gone)[:-1] > 0
            figures[2, i] = gone[0] + np.count_nonzero(gone[1:] & ~gone[:-1])
            kept.append(data[~gone].tobytes())
            figures[1, i] = len(data) - len(kept[-1])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *map(pa.array, figures)],
                                         ["doc_id", "kept", "n_bytes", "n_removed", "n_spans"])


def _hot_parts(hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts of hot contexts: the first of each (where a bucket holds others too), and the marks of its copies."""
    place = F.struct("doc_order", "row", "at")
    parts = hot.select("seed", F.xxhash64(F.lit(7), "bytes").alias("content"), "doc_order", "row", "at", "bytes")
    least = stored(parts.groupBy("seed", "content").agg(
        F.min(F.struct("doc_order", "row", "at", "bytes")).alias("least"), F.count("*").alias("n")))
    several = least.groupBy("seed").agg(F.count("*").alias("contents")).where("contents > 1")
    firsts = least.join(several, "seed", "left_semi").select("seed", "least.*")
    repeats = least.where("n > 1").select("seed", "content", F.struct("least.doc_order", "least.row", "least.at").alias("least"))
    copies = parts.join(repeats, ["seed", "content"]).where(place != F.col("least")).select(
        "row", "at", (F.octet_length("bytes") - (LENGTH - 1)).alias("windows"))
    return firsts, copies


def drop_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, kept (binary), n_bytes, n_removed, n_spans per row of ``docs`` (doc_id bigint, text).

    Every byte goes that lies in a string of LENGTH bytes which also starts earlier: in a smaller
    doc_id, or before in the same text.  Texts are their UTF-8 bytes; matches never cross rows and
    are judged on the input.  ``docs`` is read and numbered once.

    Defined cases: null and empty texts have no bytes; texts below LENGTH bytes are kept; null
    doc_ids come before all others; rows of one doc_id follow the order of the table, so of
    repeated rows the first stays; an empty table gives no row; other columns do not come along.
    """
    # Numbered once: another reading of the same table may have other partitions and so other numbers.
    numbered = stored(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.col("text").cast("binary").alias("text")))
    occurrences = stored(numbered.where(F.octet_length("text") >= LENGTH).mapInArrow(
        _occurrences, "repeat boolean, seed bigint, context bigint, doc_id bigint, row bigint, at bigint, windows int"))
    single = occurrences.where("not repeat").drop("repeat")
    # Buckets of two entries at least; mixed: not all of them have the same context.
    buckets = stored(single.groupBy("seed").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"))
                     .where("n > 1").select("seed", "n", (F.col("a") != F.col("b")).alias("mixed")))
    order = Window.partitionBy("seed", "context").orderBy(F.col("doc_id").asc_nulls_first(), "row", "at")
    met = stored(single.join(buckets, "seed").repartition("seed", "context").withColumn("nth", F.row_number().over(order))
                 .where("nth > 1 or mixed"))
    wanted = (met.where("nth = 1").groupBy("row").agg(F.collect_list(F.struct(
        "seed", "at", "windows", (F.col("n") > HOT).alias("hot"))).alias("wanted")))
    doc_order = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    contexts = stored(numbered.join(wanted, "row").select(doc_order.alias("doc_order"), "row", "text", "wanted").mapInArrow(
        _contexts, "seed bigint, hot boolean, doc_order bigint, row bigint, at bigint, bytes binary"))
    firsts, copies = _hot_parts(contexts.where("hot"))
    texts = contexts.where("not hot").drop("hot").unionByName(firsts)
    total = texts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("seed"), F.lit(int(total // SHARD_BYTES + 1)))
    indexed = texts.withColumn("shard", shard).groupBy("shard").applyInArrow(_indexed, "row bigint, at bigint, windows int")
    marks = (occurrences.where("repeat").select("row", "at", "windows")
             .unionByName(met.where("nth > 1").select("row", "at", "windows"))
             .unionByName(indexed).unionByName(copies))
    marked = marks.groupBy("row").agg(F.collect_list(F.struct("at", "windows")).alias("marks"))
    return numbered.join(marked, "row", "left").select(F.col("doc_id").cast("bigint"), "text", "marks").mapInArrow(
        _kept, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")
