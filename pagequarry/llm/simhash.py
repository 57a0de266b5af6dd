"""SimHash near-dedup: a positional byte index, count filtering, verification, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import shielded, stored, text_hash, without
from pagequarry.llm.components import components

WORDS, SEED, MAX_BITS = 4, 42, 4
# At most four differing bits leave at least four of the eight bytes equal in place.
BYTES = 8
MIN_SHARED = BYTES - MAX_BITS
# A posting list longer than this is compared block by block.
BLOCK = 4096


def fingerprint(data: bytes) -> int:
    """Majority of the bits of XXH64 over all word shingles, repeats included."""
    words = data.lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    if len(words) <= WORDS:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(s, SEED) for s in map(b" ".join, zip(*(words[i:] for i in range(WORDS)), strict=False))]
    values = np.array(hashes, np.uint64)
    for first in range(0, len(values), 1 << 16):
        part = values[first:first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(values), bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def _fingerprint(texts: pd.Series) -> pd.Series:
    found = np.fromiter((fingerprint(t or b"") for t in texts), np.uint64, len(texts))
    return pd.Series(found.view(np.int64))


def fingerprints(text: Column) -> Column:
    """64-bit fingerprint (as a signed bigint) of a string column; null counts as empty."""
    return _fingerprint(text.cast("binary"))


def covering_triples() -> list[tuple[int, int, int]]:
    """Triples of byte positions of which every set of four positions contains one.

    Positions fall into three classes; a triple lies in one class, or has two positions in one
    and the third in the next class round the circle: 20 triples for 8 positions.
    """
    kind = [p * 3 // BYTES for p in range(BYTES)]

    def chosen(triple) -> bool:
        n = [sum(kind[p] == c for p in triple) for c in range(3)]
        return 3 in n or any(n[c] == 2 and n[(c + 1) % 3] == 1 for c in range(3))
    return [t for t in combinations(range(BYTES), 3) if chosen(t)]


def postings(nodes: DataFrame) -> DataFrame:
    """key, fp: the positional bytes of each fingerprint, three at a time.

    Lists of one positional byte hold a 256th of everything; sharing four bytes implies sharing
    one of the covering triples, whose lists are 65,536 times shorter.
    """
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(BYTES)]
    keys = [F.lit(i << 24) + F.shiftleft(byte[a], 16) + F.shiftleft(byte[b], 8) + byte[c]
            for i, (a, b, c) in enumerate(covering_triples())]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def linked(x: np.ndarray) -> np.ndarray:
    """Of XORed pairs: the count filter on shared positional bytes first, then the bits."""
    shared = (np.ascontiguousarray(x).view(np.uint8).reshape(*x.shape, BYTES) == 0).sum(axis=-1)
    out = shared >= MIN_SHARED
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def spanning(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of one posting list: every node but one per tree, once."""
    left, edges, frontier = fps, [], []
    while len(left) or frontier:
        if not frontier:
            frontier, left = [left[0]], left[1:]
            continue
        node = frontier.pop()
        if len(left):
            near = linked(left ^ node)
            edges += [(int(node), int(x)) for x in left[near]]
            frontier += list(left[near])
            left = left[~near]
    return edges


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(0)
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
        sizes, edges = np.diff(ends), []
        two = ends[:-1][sizes == 2]
        near = linked(flat[two] ^ flat[two + 1]) if len(two) else np.zeros(0, bool)
        for i in np.flatnonzero(sizes > 2):
            edges += spanning(flat[ends[i]:ends[i + 1]])
        a = np.concatenate([flat[two][near], np.array([e[0] for e in edges], np.uint64)])
        b = np.concatenate([flat[two + 1][near], np.array([e[1] for e in edges], np.uint64)])
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def links(nodes: DataFrame) -> DataFrame:
    """a, b: enough links between distinct fingerprints to connect all that differ in few bits.

    Each posting list gives a spanning forest of its links instead of all its pairs.  A list of
    more than BLOCK entries is dealt into blocks, and every two blocks meet in one small group.
    """
    lists = postings(nodes)
    shared = lists.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = (lists.join(shared, "key").withColumn("blocks", blocks)
             .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
    return dealt.select("fps").mapInArrow(_forests, "a bigint, b bigint").distinct()


def near_classes(rows: DataFrame) -> DataFrame:
    """fp, root (one fingerprint of the component), component_id (its smallest doc_id)."""
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = components(stored(links(nodes.select("fp"))))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("component", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id per row of ``docs``.

    Equal fingerprints are one node, so copies cost nothing more; different ones link when they
    differ in at most MAX_BITS bits, and components follow the links any number of steps.

    Defined cases: null and blank texts have fingerprint zero and link like others; repeated rows
    each give a row; null ids never name a component unless it has no other; an empty table gives
    an empty result; other columns do not come along.
    """
    rows = stored(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")))
    return (rows.join(near_classes(rows), "fp")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"))


@shielded()
def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id, then text hash."""
    marked = docs.withColumn("__fp", fingerprints(F.col("text"))) \
        .withColumn("__text", text_hash(F.coalesce("text", F.lit("")), 1))
    rows = stored(marked.select("doc_id", F.col("__fp").alias("fp"), F.col("__text").alias("text")))
    ranked = rows.join(near_classes(rows.select("doc_id", "fp")), "fp")
    first = (ranked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text")).alias("lead"))
             .select(F.col("lead.doc_id").alias("__id"), F.col("lead.text").alias("__lead")))
    plain = docs.withColumn("__text", text_hash(F.coalesce("text", F.lit("")), 1))
    kept = plain.join(first, plain["doc_id"].eqNullSafe(first["__id"]) & (plain["__text"] == first["__lead"]), "left_semi")
    return without(kept.dropDuplicates(["doc_id", "__text"]), ("__text",))
