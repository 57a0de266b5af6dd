"""Quality classifier: a factorisation machine over hashed words, structure and metadata."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import without

BUCKETS = 1 << 16
# At most this many labelled documents are fitted on, the first by a hash of their doc_id.
SAMPLE = 9_000
FACTORS, EPOCHS, RATE, DECAY, BATCH = 8, 6, 0.08, 1e-5, 128
STATS = ("words", "word_length", "distinct", "upper", "digit", "letter", "mark", "space", "line_words", "same_lines",
         "marked_words", "shouted", "top_word", "extra")
BINS = 16
WIDTH = BUCKETS + len(STATS) * (BINS + 1)
_UPPER, _DIGIT, _MARK = re.compile(r"[A-Z]"), re.compile(r"[0-9]"), re.compile(r"[^\w\s]")
ADDED = ("score", "predicted")


def held_out(doc_id: Column) -> Column:
    """Documents that are never fitted on; a null id is not one of them (and has no label)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def statistics(text: str, words: list[str], counts: Counter, extra: float) -> list[float]:
    """Structure of a text as numbers between 0 and 1, in the order of STATS."""
    n, m = max(len(text), 1), max(len(words), 1)
    lines = text.split("\n")
    marks = len(_MARK.findall(text))
    marked = sum(c for w, c in counts.items() if len(w) > 1 and not w[-2].isalnum() and not w[-1].isalnum())
    shouted = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    blanks = n - sum(len(w) * c for w, c in counts.items())
    return [min(1.0, np.log1p(len(words)) / 12), min(1.0, (n - blanks) / m / 16), len(counts) / m,
            len(_UPPER.findall(text)) / n, len(_DIGIT.findall(text)) / n, sum(map(str.isalpha, counts)) / max(len(counts), 1),
            marks / n, min(1.0, blanks / n), min(1.0, np.log1p(m / len(lines)) / 8), 1 - len(set(lines)) / len(lines),
            marked / m, shouted / m, max(counts.values(), default=0) / m, extra]


def features(text: str | None, extra: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values: hashed words of unit length, then every statistic as value and as bin."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    size = len(counts)
    index = np.fromiter((zlib.crc32(w.encode()) for w in counts), np.int64, size) % BUCKETS
    value = 1 + np.log(np.fromiter(counts.values(), np.float64, size))
    value /= max(np.sqrt((value * value).sum()), 1e-9)
    stats = np.array(statistics(text, words, counts, min(1.0, np.log1p(max(extra, 0)) / 16)))
    bins = np.minimum((np.sqrt(np.clip(stats, 0, 1)) * BINS).astype(np.int64), BINS - 1)
    first = BUCKETS + np.arange(len(STATS)) * (BINS + 1)
    return (np.concatenate([index, first, first + 1 + bins]).astype(np.int32),
            np.concatenate([value, stats, np.full(len(STATS), 0.5)]).astype(np.float32))


@dataclass
class Machine:
    """score = bias + sum w x + half of the sum over factors of (sum v x)^2 - sum (v x)^2."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One margin per row; ``starts`` are the rows' first places; no row is empty."""
        vx = self.factors[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, starts), np.add.reduceat((vx * vx).sum(axis=1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * ((sums * sums).sum(axis=1) - squares)


def sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Machine:
    """Adagrad on the log loss in small batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    share = np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(WIDTH, np.float32),
                      rng.normal(0, 0.05, (WIDTH, FACTORS)).astype(np.float32))
    seen_w, seen_v, seen_b = np.full(WIDTH, 1e-6, np.float32), np.full((WIDTH, FACTORS), 1e-6, np.float32), 1e-6
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            part = order[at:at + BATCH]
            index, value = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
            lengths = np.array([len(rows[i][0]) for i in part])
            starts, of = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(part)), lengths)
            error = (sigmoid(machine.margins(index, value, starts)) - labels[part]) / len(part)
            used, place = np.unique(index, return_inverse=True)
            scaled = (error[of] * value).astype(np.float32)
            sums = np.add.reduceat(machine.factors[index] * value[:, None], starts)
            pull = scaled[:, None] * (sums[of] - machine.factors[index] * value[:, None])
            grad_w = np.bincount(place, scaled, len(used)) + DECAY * machine.weights[used]
            grad_v = np.stack([np.bincount(place, pull[:, k], len(used)) for k in range(FACTORS)], 1) + DECAY * machine.factors[used]
            seen_w[used] += grad_w ** 2
            seen_v[used] += grad_v ** 2
            seen_b += error.sum() ** 2
            machine.weights[used] -= RATE * grad_w / np.sqrt(seen_w[used])
            machine.factors[used] -= RATE * grad_v / np.sqrt(seen_v[used])
            machine.bias -= RATE * error.sum() / np.sqrt(seen_b)
    return machine


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(len(batch)):
            index, value = features(batch.column(1)[i].as_py(), batch.column(2)[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([index.tobytes()], pa.binary()),
                                              pa.array([value.tobytes()], pa.binary())], ["label", "index", "value"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", extra: str = "n_chars", sample: int = SAMPLE) -> Machine:
    """Fit on at most ``sample`` labelled documents outside the held-out part.

    The sample is the same at every run (order of a hash of doc_id) and keeps the natural shares
    of both labels.  Rows without text, id or label are left out; no labelled row at all gives
    the machine of the bias alone.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    chosen = (known.where(~held_out(F.col("doc_id"))).select("doc_id", "label")
              .orderBy(F.xxhash64(F.lit("sample"), "doc_id"), "doc_id").limit(sample))
    texts = docs.select("doc_id", "text", _number(docs, extra).alias("extra")).where("text is not null")
    # At most ``sample`` rows of an id and a number: a bounded broadcast.
    # Of several rows of one id the smallest text counts, whatever the order they are read in.
    rows = (texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("text", "extra")).alias("t"))
            .orderBy("doc_id").select("label", "t.text", "t.extra"))
    found = rows.mapInArrow(_vectors, "label int, index binary, value binary").toArrow()
    vectors = [(np.frombuffer(i.as_py(), np.int32), np.frombuffer(v.as_py(), np.float32))
               for i, v in zip(found["index"], found["value"], strict=True)]
    return fit(vectors, found["label"].to_numpy().astype(np.float64))


def _number(docs: DataFrame, name: str) -> Column:
    return F.coalesce(F.nanvl(F.col(f"`{name}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if name in docs.columns else F.lit(0.0)


def scorer(machine: Machine):
    """A column function (text, extra) -> score; the machine travels once with the function (2.5 MB)."""
    @F.pandas_udf("double")
    def score(texts: pd.Series, extras: pd.Series) -> pd.Series:
        out = np.empty(len(texts))
        for first in range(0, len(out), 128):
            rows = [features(t, e) for t, e in zip(texts[first:first + 128], extras[first:first + 128], strict=True)]
            lengths = np.array([len(i) for i, _ in rows])
            margins = machine.margins(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]),
                                      np.cumsum(lengths) - lengths)
            out[first:first + 128] = sigmoid(margins)
        return pd.Series(out)
    return score


def classify(docs: DataFrame, machine: Machine, extra: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher: better) and ``predicted`` (1 from ``threshold`` on).

    Inputs of the score are the whole text and the one metadata number ``extra``; nothing else.

    Defined cases: a null or empty text is scored by its structure alone; a null, missing or
    negative ``extra`` counts as 0; rows are independent, so repeats, ties and empty tables need
    no rule; columns named like the added ones are replaced, others pass.
    """
    rest = without(docs, ADDED)
    return (rest.withColumn("score", scorer(machine)(F.col("text"), _number(docs, extra)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
