"""Query memory of a run: a query asked before is told when, instead of being searched again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

OUTPUT = "key string, step bigint, query string, prior_step bigint"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def search_key(tool: Column, query: Column) -> Column:
    """Queries of one tool are equal up to case and outer blanks."""
    return F.concat(tool, F.lit(":"), F.lower(F.trim(F.coalesce(query, F.lit("")))))


class FirstStep(StatefulProcessor):
    """Keeps the step of the first query per key; it is forgotten after ``ttl_ms`` without a new key (0: never)."""

    def __init__(self, ttl_ms: int = 0):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", StructType([StructField("step", LongType())]), ttlDurationMs=self.ttl_ms or None)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        known = self.first.get()[0] if self.first.exists() else None
        # One key in one micro-batch: repeats of the same query within a few steps.
        for step, query in sorted((r["step"], r["query"]) for r in rows):
            yield Row(key=key[0], step=step, query=query, prior_step=known)
            if known is None:
                known = step
                self.first.update((step,))

    def close(self) -> None:
        pass


def seen_queries(asked: DataFrame, ttl_ms: int = 0) -> DataFrame:
    """key, step, query, prior_step of a stream of (tool, query, step): prior_step is null where the query is fresh.

    The memory is state keyed by the query, so it grows with the different queries, is spread over
    tasks, and lives in the checkpoint: a restarted stream remembers.  Needs the RocksDB state store
    (:data:`STORE` set to :data:`ROCKS`).  Steps must rise from micro-batch to micro-batch.
    """
    keyed = asked.select(search_key(F.col("tool"), F.col("query")).alias("key"), F.col("step").cast("bigint").alias("step"), "query")
    return keyed.groupBy("key").transformWithState(FirstStep(ttl_ms), StructType.fromDDL(OUTPUT), "append", "none")
