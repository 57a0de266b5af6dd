"""Packing: all token ids are one long tape, cut into sequences of a fixed length."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import stored

END_ID = 0
CACHE_ENTRIES = 250_000
LONG_PIECE = 2_000
_DOUBLE_BLANK = re.compile(r"\s\s")
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


class ByteBPE:
    """Ids of a byte-level BPE as little-endian 32-bit bytes.

    A lone space between two other characters always starts a token of this vocabulary's split
    pattern, so a text is the sum of its space-separated pieces, and pieces repeat: they are
    encoded once and looked up after that.  Short pieces go to the rank table, long ones (where
    its merge loop would be quadratic) to the tokenizer library, which reads the same vocabulary.
    Strings of its special tokens are cut out first, as the library does, and are one id each.
    """

    def __init__(self, ranks_path: str, tokenizer_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._long = Tokenizer.from_file(tokenizer_path)
        self._known: dict[str, bytes] = {}
        self._special = {t.content: np.asarray([i], "<u4").tobytes() for i, t in self._long.get_added_tokens_decoder().items()}
        self._cut = re.compile("(" + "|".join(re.escape(c) for c in sorted(self._special, key=len, reverse=True)) + ")") if self._special else None

    def _ids(self, piece: str) -> bytes:
        ids = self._short(piece) if len(piece) <= LONG_PIECE else self._long.encode(piece, add_special_tokens=False).ids
        return np.asarray(ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        return b"".join(self._special.get(part) or self._plain(part) for part in self._cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        pieces = _LONE_SPACE.split(text) if _DOUBLE_BLANK.search(text) else text.split(" ")
        known, out, get = self._known, [self._ids(pieces[0])], self._known.get
        for piece in pieces[1:]:
            ids = get(piece)
            if ids is None:
                ids = self._ids(" " + piece)
                if len(piece) <= 64:
                    if len(known) >= CACHE_ENTRIES:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return b"".join(out)


def default_paths() -> tuple[str, str, str]:
    """The public 50k byte-level vocabulary: rank table, tokenizer file, split pattern."""
    import public_tokenizers as public
    return public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN


def _tokenize(paths):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, tape = ByteBPE(*paths), TaskContext.get().partitionId(), 0
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            keys, texts, first = batch.column(0), batch.column(1), 0
            while first < len(keys):
                ids, starts, size, last = [], [], 0, first
                while last < len(keys) and size < 8_000_000:
                    ids.append(encode(texts[last].as_py() or "") + end)
                    starts.append(tape)
                    tape += len(ids[-1]) // 4
                    size += len(ids[-1])
                    last += 1
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(first, last - first), pa.array(ids, pa.binary()), pa.array(starts, pa.int64()),
                     pa.array([part] * len(ids), pa.int32())], ["doc_id", "ids", "tape", "part"])
                first = last
    return run


def tokenized(docs: DataFrame, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, ids (little-endian 32-bit, with the end id), tape (ids before it in its part), part."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _tokenize(paths or default_paths()), f"doc_id {kind}, ids binary, tape bigint, part int")


def pack(docs: DataFrame, length: int = 1024, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row per piece.

    First pass: every document becomes its ids and the end id, numbered along its partition, and
    is written once.  Second pass: the totals of the partitions (one row each, as many as the
    first pass had tasks, which bounds the broadcast) become offsets by a prefix sum, every
    document learns its place on the tape, and is cut where the tape crosses a multiple of
    ``length``.  Only the last sequence is not full.

    Defined cases: a null or empty text is the end id alone; repeated rows and null ids are each
    packed by themselves; an empty table gives no piece; other columns do not come along.
    """
    rows = stored(tokenized(docs, paths)).withColumn("doc_tokens", (F.octet_length("ids") / 4).cast("long"))
    offsets = (rows.groupBy("part").agg(F.sum("doc_tokens").alias("tokens"))
               .select("part", (F.sum("tokens").over(Window.orderBy("part")) - F.col("tokens")).alias("before")))
    at, n = F.col("at"), F.lit(length)
    placed = rows.join(F.broadcast(offsets), "part").withColumn("at", F.col("before") + F.col("tape"))
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(
        F.floor(at / n), F.floor((at + F.col("doc_tokens") - 1) / n))))
    start = F.greatest(F.lit(0), F.col("sequence_id") * n - at)
    stop = F.least(F.col("doc_tokens"), (F.col("sequence_id") + 1) * n - at)
    return (cut.withColumn("start", start).withColumn("length", stop - start)
            .withColumn("ids", F.col("ids").substr((F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
            .withColumn("offset", at + F.col("start") - F.col("sequence_id") * n)
            .select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"))
