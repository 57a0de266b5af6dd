"""Shared steps of the operators in this package."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.session import shared_folder

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# The white space of the contracts: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def stored(df: DataFrame) -> DataFrame:
    """Write once to the shared folder and read again; the shuffle files of the write go at once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_hash(text: Column, salt: int) -> Column:
    """64 bits of a text; two salts make an identity of 128 bits."""
    return F.xxhash64(F.lit(salt), text)


def without(df: DataFrame, names) -> DataFrame:
    """The frame without columns that an operator is about to write under the same name."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def shielded(*names: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Columns named like an operator's own (two underscores in front, or in ``names``) pass under other names and come back."""
    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            mine = [c for c in docs.columns if c.startswith("__") or c.lower() in names]
            if not mine:
                return operator(docs, *args, **kwargs)
            n = max(map(len, docs.columns))
            away = {c: f"{'hidden':_<{n}}{i}" for i, c in enumerate(mine)}   # longer than any name there is
            return operator(docs.withColumnsRenamed(away), *args, **kwargs).withColumnsRenamed({v: k for k, v in away.items()})
        return run
    return wrap
