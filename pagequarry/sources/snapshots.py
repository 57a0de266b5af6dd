"""Versioned tables: every change is a new snapshot that appears at once; readers keep the one they opened.

Rows are dealt to buckets by key.  A change writes the touched buckets anew into a folder of its
own and then adds one line to the log: which folder holds which bucket from now on.  That line is
the only switch.  A writer that dies before it leaves the old state; folders no line names
are never read.  All access is by Spark's readers and writers, so any store they reach will do.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
_LOG = "version bigint, token string, folders map<int, string>, note string"


class ChangeRejected(ValueError):
    """A check found problems in the new snapshot; the table is as it was."""


class ConcurrentChange(RuntimeError):
    """Another writer switched to the same version first; read again and repeat the change."""


class SnapshotTable:
    """A table with a key under a path."""

    def __init__(self, spark: SparkSession, path: str, keys: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, keys, buckets

    # --- the log -------------------------------------------------------------------------------

    def log(self) -> DataFrame:
        """version, token, folders, note of every switch; of two writers of one version the smaller token won."""
        try:
            rows = self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _LOG)
        return rows.groupBy("version").agg(F.min_by(F.struct("token", "folders", "note"), "token").alias("w")).select("version", "w.*")

    def _state(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        """The newest (or the named) version and the folder of each of its buckets: one row to the driver."""
        rows = self.log() if version is None else self.log().where(F.col("version") == version)
        last = rows.orderBy(F.desc("version")).limit(1).collect()
        if not last and version is not None:
            raise KeyError(f"no version {version}")
        return (last[0]["version"], dict(last[0]["folders"])) if last else (0, {})

    def version(self) -> int:
        """0 before the first write."""
        return self._state()[0]

    # --- reading ---------------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of one snapshot; later changes do not touch what this frame reads."""
        folders = self._state(version)[1]
        if not folders:
            raise LookupError(f"nothing was written to {self.path} yet")
        return self._rows(folders)

    def _rows(self, folders: dict[int, str], only: set[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items()) if b >= 0 and (only is None or b in only)]
        # Every change also writes an empty table, which keeps the schema where no bucket has rows.
        return self.spark.read.parquet(*(paths or [f"{self.path}/data/{next(iter(folders.values()))}/empty"]))

    def exists(self) -> bool:
        return self.version() > 0

    # --- changing --------------------------------------------------------------------------------

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame, check: Callable[[DataFrame], DataFrame] | None = None, note: str = "") -> int:
        """Replace the whole table."""
        return self._switch(rows, None, check, note)

    def merge(self, changed: DataFrame, gone: DataFrame | None = None,
              check: Callable[[DataFrame], DataFrame] | None = None, note: str = "") -> int:
        """Rows of ``changed`` replace rows of equal key or are added; keys of ``gone`` go.  Only their buckets are written."""
        version, folders = self._state()
        if not folders:
            return self._switch(changed, None, check, note)
        keys = changed.select(*self.keys)
        keys = keys if gone is None else keys.unionByName(gone.select(*self.keys))
        touched = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}   # at most one row a bucket
        old = self._rows(folders, touched)
        left = old.join(keys.distinct(), list(self.keys), "left_anti")
        return self._switch(left.unionByName(changed, allowMissingColumns=True).select(*old.columns), (version, folders, touched), check, note)

    def _switch(self, rows: DataFrame, change: tuple[int, dict[int, str], set[int]] | None, check, note: str) -> int:
        version, folders, touched = change or (*self._state(), None)
        token = uuid.uuid4().hex
        folder = f"{self.path}/data/{token}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(folder)
        rows.limit(0).coalesce(1).write.parquet(f"{folder}/empty")
        try:
            filled = {r[0] for r in self.spark.read.option("basePath", folder).parquet(f"{folder}/bucket=*").select("bucket").distinct().collect()}
        except AnalysisException as error:   # no bucket has a row
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            filled = set()
        kept = {} if touched is None else {b: f for b, f in folders.items() if b not in touched}
        after = {**kept, **dict.fromkeys(filled, token)}
        if check is not None:
            problems = check(self._rows(after) if after else rows.limit(0)).limit(5).collect()
            if problems:
                raise ChangeRejected(f"version {version + 1} of {self.path}: {problems}")
        line = [(version + 1, token, after or {-1: token}, note)]
        self.spark.createDataFrame(line, _LOG).coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        winner = self.log().where(F.col("version") == version + 1).first()
        if winner["token"] != token:
            raise ConcurrentChange(f"version {version + 1} of {self.path} was written by another job")
        return version + 1
