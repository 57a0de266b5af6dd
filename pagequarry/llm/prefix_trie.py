"""Conversation prefix trie: union-find over the LCPs of sorted neighbours, forests merged across partitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

# One turn in a sequence: 16 bytes of digest, 4 bytes with the words of its text.  Fixed width, so
# that sequences sort as bytes and a prefix of a sequence is a prefix of its bytes.
RECORD = 20
HEAD_TURNS = 3
FAMILY = 20
CHUNK_BYTES = 64_000
PARTITION_BYTES = 32_000_000
ROWS = 20_000
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE = ("conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
        "saved_tokens bigint, ends_sha256 string")
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
# CLOSED: a node with its parent; WAITING: a node whose parent is the spine's node at open_depth;
# SPINE: the first or last sequence of a partition and what hangs on it; LINK: a spine's node and its conv_id.
CLOSED, WAITING, SPINE, LINK = range(4)
FOREST = (f"kind int, {NODE}, part int, spine int, open_depth bigint, seq binary, hangs array<struct<depth: bigint, n: bigint, "
          "low: bigint, children: bigint, leaves: bigint, saved: bigint, ends: string>>")
_HANG = [(n, pa.int64()) for n in ("depth", "n", "low", "children", "leaves", "saved")] + [("ends", pa.string())]
_FOREST = pa.schema([("kind", pa.int32()), *((n, pa.int64()) for n in COLUMNS[:-1]), ("ends_sha256", pa.string()), ("part", pa.int32()),
                     ("spine", pa.int32()), ("open_depth", pa.int64()), ("seq", pa.binary()), ("hangs", pa.list_(pa.struct(_HANG)))])


# --- conversations as byte strings ------------------------------------------------------------------

def turn_records(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, start (of the text), record: what is left of a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), F.left(text, F.lit(24)).alias("start"),
        F.unhex(F.concat(digest, F.lpad(F.hex(words), 8, "0"))).alias("record"))


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations: the records of a conversation that follow each other in this partition."""
    key, held, piece = None, [], 0
    part = TaskContext.get().partitionId()

    def out(rows):
        ids, places, seqs = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int64()), pa.array(seqs, pa.binary())],
                                          ["conv_id", "place", "seq"])
    done = []
    for batch in batches:
        for conv, record in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if held and conv != key:
                done.append((key, (part << 32) + piece, b"".join(held)))
                held, piece = [], piece + 1
                if len(done) >= ROWS:
                    yield out(done)
                    done = []
            key = conv
            held.append(record)
    if held:
        done.append((key, (part << 32) + piece, b"".join(held)))
    if done:
        yield out(done)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, seq: the turns of each conversation in order; a long one is strung in several tasks."""
    records = stored(turn_records(turns))
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "start", "record"]
    pieces = (records.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "record")
              .mapInArrow(_strung, "conv_id bigint, place bigint, seq binary"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "seq"))), lambda p: p["seq"])
    return pieces.groupBy("conv_id").agg(F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("seq"))


def _records(seq: Column, first: Column | int, n: Column | None = None) -> Column:
    start = (F.lit(first) if isinstance(first, int) else first) * RECORD + 1
    return seq.substr(start, F.lit(1 << 30) if n is None else n * RECORD)


def rebuilt(convs: DataFrame, family: int = FAMILY, heads: int = HEAD_TURNS) -> DataFrame:
    """conv_id, seq: the first turns of a conversation come from the first one of its family.

    How many is crc32(conv_id) mod ``heads`` + 1; the conversation's own turns follow after as many.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (heads + 1)).cast("int")
    lead = convs.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("base"), _records(F.col("seq"), 0, F.lit(heads)).alias("lead"))
    mine = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(lead, "base", "left")
    head = _records(F.coalesce("lead", F.lit(b"")), 0, h)
    return mine.select("conv_id", F.concat(head, _records(F.col("seq"), h)).alias("seq"))


# --- equal sequences become one row ------------------------------------------------------------------

def _id_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of equal sequences as text chunks; the sequence comes with the first chunk only."""
    key, seq, ids, size, fresh, done = None, None, [], 0, True, []
    names = ["key", "first", "n", "ids", "seq"]

    def close():
        done.append((key, ids[0], len(ids), ",".join(map(str, ids)), seq if fresh else None))

    def out():
        cols = zip(*done, strict=True)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
    for batch in batches:
        for k, conv, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if ids and (k != key or size > CHUNK_BYTES):
                close()
                fresh, ids, size = k != key, [], 0
                if len(done) >= ROWS // 4:
                    yield out()
                    done = []
            if k != key:
                key, seq, fresh = k, s, True
            ids.append(conv)
            size += 20
    if ids:
        close()
    if done:
        yield out()


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct sequence; the hash runs along the chunks, of which one is held at a time."""
    key, held, done = None, None, []

    def out():
        cols = zip(*((s, n, low, h.hexdigest()) for s, n, low, h in done), strict=True)
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["seq", "n", "low", "ends"])
    for batch in batches:
        for k, first, n, ids, seq in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                if held:
                    done.append(held)
                    if len(done) >= ROWS:
                        yield out()
                        done = []
                key, held = k, (seq, n, first, hashlib.sha256(ids.encode()))
            else:
                held[3].update(f",{ids}".encode())
                held = (held[0], held[1] + n, held[2], held[3])
    if held:
        done.append(held)
    if done:
        yield out()


def distinct_sequences(convs: DataFrame) -> DataFrame:
    """seq, n, low, ends: every different sequence with its conversations, their smallest id and the hash of all ids.

    Copies are counted away in every task before they meet, so a sequence behind a third of all
    conversations reaches one task as a few chunks of text.
    """
    keyed = stored(convs.select(F.unhex(F.md5("seq")).alias("key"), "conv_id", "seq"))
    chunks = (keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
              .mapInArrow(_id_chunks, "key binary, first bigint, n bigint, ids string, seq binary"))
    return (chunks.repartition("key").sortWithinPartitions("key", "first")
            .mapInArrow(_hashed_ends, "seq binary, n bigint, low bigint, ends string"))


# --- the forest ---------------------------------------------------------------------------------------

def common_records(a: bytes, b: bytes) -> int:
    """How many turns two sequences share at their start."""
    low, high = 0, min(len(a), len(b)) // RECORD
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low * RECORD:mid * RECORD] == b[low * RECORD:mid * RECORD] else (low, mid - 1)
    return low


class Tree:
    """A component of neighbouring sequences: its top node, and what is below that.

    ``first``, ``last``: the sequences it spans; ``top``: the depth of the node; ``n``, ``low``: its
    members and the smallest one; ``ends``: hash of the members that end there; ``shared``: it spans
    an end of the partition, so other partitions may hold more of its nodes.
    """

    __slots__ = ("first", "last", "top", "n", "low", "children", "leaves", "saved", "ends", "shared")

    def __init__(self, first: int, last: int, top: int, shared: bool = False):
        self.first, self.last, self.top, self.shared = first, last, top, shared
        self.n, self.low, self.children, self.leaves, self.saved, self.ends = 0, None, 0, 0, 0, None

    def add(self, n, low, children, leaves, saved, ends) -> None:
        self.n += n
        self.children += children
        self.leaves += leaves
        self.saved += saved
        self.low = low if self.low is None or (low is not None and low < self.low) else self.low
        self.ends = self.ends or ends

    def state(self) -> tuple:
        return self.n, self.low, self.children, self.leaves, self.saved, self.ends


class Forest:
    """Union-find over the edges between sorted neighbours, deepest first: each merge is a branching node.

    ``seqs`` are sorted and all different; ``hangs[i]`` tells per depth what belongs to the node of
    sequence i there: (n, low, children, leaves, saved, ends).  With ``contract`` the nodes of the
    first and the last sequence stay open and are returned in ``spines`` as what hangs on them;
    without, every node is told.
    """

    def __init__(self, seqs: list[bytes], hangs: list[dict], contract: bool):
        self.seqs, self.hangs, self.contract = seqs, hangs, contract
        self.spines: list[dict[int, Tree]] = [{}, {}]

    def _hung(self, tree: Tree, depth: int, first: int, last: int) -> None:
        if not self.contract:   # sequences of one partition end at merges only, where they join as components
            for i in range(first, last + 1):
                if depth in self.hangs[i]:
                    tree.add(*self.hangs[i][depth])

    def _close(self, tree: Tree) -> tuple:
        if not tree.children:
            tree.leaves = 1
        if tree.top:
            end = tree.top * RECORD
            tree.saved += (tree.n - 1) * int.from_bytes(self.seqs[tree.first][end - 4:end], "big")
        return tree.low, tree.top, tree.n, tree.children, tree.leaves, tree.saved, tree.ends or NO_ENDS, tree.first, tree.last

    def _climb(self, tree: Tree, depth: int) -> Iterator[tuple]:
        """Nodes of a component on its way up to ``depth``: each but the last is an only child."""
        while tree.top > depth:
            node = self._close(tree)
            tree.top, tree.children, tree.ends = tree.top - 1, 1, None
            self._hung(tree, tree.top, tree.first, tree.last)
            yield node, tree.low, None

    def _merge(self, trees: list[Tree], depth: int) -> Iterator[tuple]:
        """The node where neighbouring components meet, last; before it (node, parent or None, place of an open parent)."""
        found = Tree(trees[0].first, trees[-1].last, depth, any(t.shared for t in trees))
        below = []
        for tree in trees:
            if tree.shared:
                continue
            if tree.top == depth:
                found.add(*tree.state())
                continue
            yield from self._climb(tree, depth + 1)
            below.append(self._close(tree))
            found.add(tree.n, tree.low, 1, tree.leaves, tree.saved, None)
            self._hung(found, depth, tree.first, tree.last)
        side = 0 if found.first == 0 else 1
        for node in below:
            yield (node, None, (side, depth)) if found.shared else (node, found.low, None)
        if found.shared:
            self.spines[side].setdefault(depth, Tree(found.first, found.last, depth)).add(*found.state())
        yield found, None, None

    def nodes(self) -> Iterator[tuple]:
        """(node, conv_id of its parent, open place of its parent) for every closed node."""
        seqs, n = self.seqs, len(self.seqs)
        trees, root = [], list(range(n))
        for i, seq in enumerate(seqs):
            trees.append(Tree(i, i, len(seq) // RECORD, self.contract and i in (0, n - 1)))
            trees[i].add(*self.hangs[i].get(trees[i].top, (0, None, 0, 0, 0, None)))
            if trees[i].shared:
                self.spines[0 if i == 0 else 1].setdefault(trees[i].top, Tree(i, i, trees[i].top)).add(*trees[i].state())

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i
        deep = [0] + [common_records(a, b) for a, b in zip(seqs, seqs[1:], strict=False)]
        edges = sorted(range(1, n), key=lambda i: -deep[i])   # stable: from left to right at each depth
        at = 0
        while at < len(edges):
            depth, met = deep[edges[at]], {}
            while at < len(edges) and deep[edges[at]] == depth:
                left, right = find(edges[at] - 1), find(edges[at])
                met.setdefault(left, [trees[left]]).append(trees[right])
                root[right] = left
                trees[right] = None
                at += 1
            for left, group in met.items():
                for node, parent, place in self._merge(group, depth):
                    if isinstance(node, Tree):
                        trees[left] = self._kept(node, depth)
                    else:
                        yield node, parent, place
        if n and not self.contract:
            last = trees[0]
            yield from self._climb(last, 0)
            yield self._close(last), None, None

    def _kept(self, tree: Tree, depth: int) -> Tree:
        """A shared component goes on empty: what it held hangs on the spine now."""
        return Tree(tree.first, tree.last, depth, True) if tree.shared else tree


def _rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held = []
    for row in found:
        held.append(row)
        if len(held) >= ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FOREST, strict=True)], schema=_FOREST)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _FOREST, strict=True)], schema=_FOREST)


def _planted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of one partition of sorted sequences, contracted to the spines at its two ends."""
    seqs, hangs = [], []
    for batch in batches:
        for seq, n, low, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seqs.append(seq)
            hangs.append({len(seq) // RECORD: (n, low, 0, 0, 0, ends)})
    part, forest = TaskContext.get().partitionId(), Forest(seqs, hangs, contract=True)

    def told():
        for (conv, depth, n, children, leaves, saved, ends, _, _), parent, place in forest.nodes():
            yield (CLOSED if place is None else WAITING, conv, depth, parent, n, children, leaves, saved, ends, part,
                   *(place or (None, None)), None, None)
        for spine, seq in enumerate([seqs[0], seqs[-1]][:len(seqs)] if seqs else []):
            hung = [dict(zip([f[0] for f in _HANG], (d, *t.state()), strict=True)) for d, t in sorted(forest.spines[spine].items())]
            yield (SPINE, *[None] * 8, part, spine, None, seq, hung)
    yield from _rows(told())


def _grafted(spines: pa.Table) -> Iterator[pa.RecordBatch]:
    """The same union-find over the spines of all partitions: the open nodes, and a link to each from every spine."""
    spines = spines.sort_by([("part", "ascending"), ("spine", "ascending")])
    places = list(zip(spines["part"].to_pylist(), spines["spine"].to_pylist(), strict=True))
    hangs = [{h["depth"]: (h["n"], h["low"], h["children"], h["leaves"], h["saved"], h["ends"]) for h in row} for row in spines["hangs"].to_pylist()]

    def told():
        for (conv, depth, n, children, leaves, saved, ends, first, last), parent, _ in Forest(spines["seq"].to_pylist(), hangs, contract=False).nodes():
            yield (CLOSED, conv, depth, parent, n, children, leaves, saved, ends, *[None] * 5)
            for part, spine in places[first:last + 1]:
                yield (LINK, conv, depth, *[None] * 6, part, spine, depth, None, None)
    yield from _rows(told())


def prefix_trie(turns: DataFrame, family: int | None = FAMILY, heads: int = HEAD_TURNS) -> DataFrame:
    """One row per node of the trie of all conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    A node is a distinct sequence of first turns (role, text).  Sequences are sorted over all
    partitions; in each one, components of neighbours are merged by union-find over their common
    prefixes in descending depth, and every merge is a branching node, with the nodes between it
    and its children on the way.  Only the nodes of a partition's first and last sequence can go
    on elsewhere: a partition is contracted to these two spines and what hangs on them, and one
    task merges the spines (two rows a partition) the same way.  A conversation is one row of 20
    bytes a turn there; its turns are strung in several tasks where they are many.

    ``family``: conversations are rebuilt with the head of the first one of their family
    (:func:`rebuilt`); None takes them as they are.

    Defined cases: turns come in the order of turn (null first), then role, the start of the text
    and its digest, so repeated rows are repeated turns; a null role or text is empty; rows with a
    null conv_id take no part; an empty table gives no row; texts of any length are 20 bytes from
    the first step on; other columns, whatever their names, do not come along.
    """
    convs = sequences(turns)
    convs = rebuilt(stored(convs), family, heads) if family else convs
    distinct = stored(distinct_sequences(convs))
    size = distinct.agg(F.sum(F.octet_length("seq") + 100)).first()[0] or 0
    parts = max(-(-size // PARTITION_BYTES), distinct.sparkSession.sparkContext.defaultParallelism)
    forest = stored(distinct.repartitionByRange(parts, "seq").sortWithinPartitions("seq").mapInArrow(_planted, FOREST))
    grafted = stored(forest.where(F.col("kind") == SPINE).select("part", "spine", "seq", "hangs")
                     .groupBy(F.lit(0).alias("all")).applyInArrow(_grafted_table, FOREST))
    links = grafted.where(F.col("kind") == LINK).select("part", "spine", "open_depth", F.col("conv_id").alias("above"))
    waiting = forest.where(F.col("kind") == WAITING).join(links, ["part", "spine", "open_depth"]).withColumn("parent_conv_id", F.col("above"))
    return (forest.where(F.col("kind") == CLOSED).select(*COLUMNS).unionByName(waiting.select(*COLUMNS))
            .unionByName(grafted.where(F.col("kind") == CLOSED).select(*COLUMNS)))


def _grafted_table(spines: pa.Table) -> pa.Table:
    return pa.Table.from_batches(_grafted(spines.drop_columns(["all"]) if "all" in spines.column_names else spines), _FOREST)
