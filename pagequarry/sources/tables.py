"""Stored tables: Parquet, partitioned by database and by a bucket of the source name.

Replacing or deleting the rows of some sources rewrites only the buckets they fall into
(dynamic partition overwrite); the number of partitions does not grow with the sources.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagequarry.operators import chunking, dense, lexical
from pagequarry.operators.pages import delete_source, replace_source
from pagequarry.session import bounded_broadcast, cut_lineage

BUCKETS = 256
_INFER = "spark.sql.sources.partitionColumnTypeInference.enabled"


class SourceTable:
    """One table keyed by (db, source) under a path."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64("source"), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder)

    def write(self, rows: DataFrame) -> None:
        self._placed(rows).write.mode("overwrite").partitionBy("db", "bucket").parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        self._placed(rows).write.mode("append").partitionBy("db", "bucket").parquet(self.path)

    def drop(self, dbs: DataFrame) -> None:
        """Remove everything of the given databases (db): their folders go, no row is rewritten."""
        if not self.exists():
            return
        known = dbs.select(F.col("db").alias("_db")).distinct()
        self._remove(self._folders(levels=2).join(known, F.col("db").eqNullSafe(F.col("_db")), "left_semi"))

    def _folders(self, levels: int) -> DataFrame:
        """db, bucket, folder: where the rows are, 1 level above their files (buckets) or 2 (databases).

        The names come from the files themselves: Spark escapes what a folder name cannot hold.
        """
        return self._stored().select("db", "bucket", F.regexp_replace("_metadata.file_path", rf"(?:/[^/]*){{{levels}}}\z", "").alias("folder"))

    def _remove(self, folders: DataFrame) -> None:
        self._remove_all(row["folder"] for row in folders.select("folder").distinct().collect())

    def _remove_all(self, folders: Iterable[str]) -> None:
        jvm = self.spark._jvm
        for name in folders:   # at most one per database and bucket
            folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _files(self) -> DataFrame:
        """db, bucket, file: one row per file of the table; no column of its rows is read."""
        return self._stored().select("db", "bucket", F.col("_metadata.file_path").alias("file")).distinct()

    def _stored(self) -> DataFrame:
        """The table with its partition columns; database names are text, whatever they look like."""
        before = self.spark.conf.get(_INFER)
        self.spark.conf.set(_INFER, "false")
        try:
            rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        finally:
            self.spark.conf.set(_INFER, before)
        return rows.withColumn("bucket", F.col("bucket").cast("int"))

    def counted(self) -> DataFrame:
        """db, source, n: one or more rows per source, with how many rows of :meth:`read` each stands for."""
        return self._stored().select("db", "source", F.lit(1).cast("bigint").alias("n"))

    def read(self, dbs: list[str] | None = None) -> DataFrame:
        rows = self._stored()
        return (rows if dbs is None else rows.where(F.col("db").isin(dbs))).drop("bucket")

    def replace(self, sources: DataFrame, new_rows: DataFrame | None = None) -> None:
        """Replace (or with no new rows delete) everything of the given (db, source) rows."""
        if not self.exists():
            if new_rows is not None:
                self.write(new_rows)
            return
        sources = cut_lineage(sources.select("db", "source").distinct())
        touched = bounded_broadcast(cut_lineage(self._placed(sources).select("db", "bucket").distinct()))
        stored = self._stored()
        before = cut_lineage(self._files().join(touched, ["db", "bucket"], "left_semi"))
        old = stored.join(touched, ["db", "bucket"], "left_semi")
        columns = stored.columns
        if new_rows is None:
            left = delete_source(old, sources)
        else:
            left = replace_source(old, self._placed(new_rows).select(*columns), sources)
        (left.select(*columns).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("db", "bucket").parquet(self.path))
        # a bucket left without rows is not part of the overwrite: it alone still has its old files
        self._remove(self._files().join(before.select("file"), "file", "left_semi")
                     .select(F.regexp_replace("file", r"/[^/]*\z", "").alias("folder")))


class PostingsTable(SourceTable):
    """Postings, stored as one packed row per chunk, so that a change handles chunks and not terms."""

    def packed(self) -> DataFrame:
        return super().read()

    def counted(self) -> DataFrame:
        return self._stored().select("db", "source", F.size("found").cast("bigint").alias("n"))

    def read(self, dbs: list[str] | None = None) -> DataFrame:
        return lexical.unpacked(super().read(dbs))


class KnowledgeStore:
    """Chunks, postings, lengths, vectors and questions of all databases under one folder.

    Vectors are optional: a store without them stays lexical, and changes keep them up to date
    only where they were built with the model that the change names.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark = spark
        self.chunks = SourceTable(spark, f"{folder}/chunks", buckets)
        self.postings = PostingsTable(spark, f"{folder}/postings", buckets)
        self.lengths = SourceTable(spark, f"{folder}/lengths", buckets)
        self.vectors = SourceTable(spark, f"{folder}/vectors", buckets)
        self.questions = SourceTable(spark, f"{folder}/questions", buckets)
        self.versions = SourceTable(spark, f"{folder}/versions", buckets)

    def tables(self) -> dict[str, SourceTable]:
        return {"chunks": self.chunks, "postings": self.postings, "lengths": self.lengths, "vectors": self.vectors,
                "questions": self.questions, "versions": self.versions}

    def build(self, chunks: DataFrame) -> None:
        """Full build: the first row of every chunk id is indexed."""
        self.chunks.write(chunks)
        postings, lengths = _indexed(self.chunks.read())
        self.postings.write(postings)
        self.lengths.write(lengths)

    def build_vectors(self, model: dense.Model, name: str) -> None:
        """Embed every chunk; ``name`` says with which model from now on."""
        self.vectors.write(_embedded(self.chunks.read(), model, name))

    def has_vectors(self, name: str) -> bool:
        return self.vectors.exists() and not self.vectors.read().where(F.col("model") == name).isEmpty()

    def replace(self, documents: DataFrame, model: dense.Model | None = None, name: str = "") -> None:
        """Re-chunk and re-index some sources (db, source, text); all others stay as they are."""
        new = chunking.split_documents(documents.select("db", "source", "text")).withColumn("scope", F.lit("raw"))
        self.replace_chunks(documents.select("db", "source").distinct(), new, model, name)

    def replace_chunks(self, sources: DataFrame, chunks: DataFrame, model: dense.Model | None = None, name: str = "") -> None:
        """Replace the chunks of ``sources`` (db, source) in every table that holds something of them."""
        sources = cut_lineage(sources.select("db", "source").distinct())
        chunks = cut_lineage(chunks)
        self.chunks.replace(sources, chunks)
        postings, lengths = _indexed(chunks)
        self.postings.replace(sources, postings)
        self.lengths.replace(sources, lengths)
        if model is not None and self.has_vectors(name):
            self.vectors.replace(sources, _embedded(chunks, model, name))

    def delete(self, sources: DataFrame) -> None:
        sources = cut_lineage(sources.select("db", "source").distinct())
        for table in self.tables().values():
            table.replace(sources)

    def reset(self, dbs: DataFrame) -> DataFrame:
        """db, table, removed: everything of the given databases goes, with the rows it had."""
        counts = None
        for name, table in self.tables().items():
            if table.exists():
                n = table.counted().join(dbs.select("db").distinct(), "db", "left_semi").groupBy("db").agg(
                    F.lit(name).alias("table"), F.sum("n").alias("removed"))
                counts = n if counts is None else counts.unionByName(n)
        counts = cut_lineage(counts) if counts is not None else self.spark.createDataFrame([], "db string, table string, removed bigint")
        for table in self.tables().values():
            table.drop(dbs)
        return counts

    def add_questions(self, questions: DataFrame) -> None:
        """Append db, source, chunk_id, question."""
        self.questions.append(questions.select("db", "source", "chunk_id", "question"))

    def delete_questions(self, sources: DataFrame) -> DataFrame:
        """db, source, removed: the questions of ``sources`` go; sources without any are not listed."""
        if not self.questions.exists():
            return self.spark.createDataFrame([], "db string, source string, removed bigint")
        gone = cut_lineage(self.questions.read().join(sources, ["db", "source"], "left_semi")
                           .groupBy("db", "source").agg(F.count("*").alias("removed")))
        self.questions.replace(sources)
        return gone

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """BM25; the size of the corpus comes from the narrow table of lengths."""
        corpus = self.lengths.read().groupBy("db").agg(F.count("*").alias("n_rows"), F.avg("length").alias("mean_length"))
        return lexical.search_postings(lexical.Postings(self.postings.read(), cut_lineage(corpus), self.postings.packed()), queries, k)

    def search_vectors(self, queries: DataFrame, model: dense.Model, name: str, k: int = 10) -> DataFrame:
        """Vector search with the stored vectors; no hits where there are none of this model."""
        rows = self.vectors.read().where(F.col("model") == name) if self.vectors.exists() else \
            self.spark.createDataFrame([], _VECTOR)
        return dense.nearest(rows, dense.embed(queries, model), k)


_VECTOR = "db string, scope string, source string, chunk_id string, model string, vec array<double>"


def _indexed(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Packed postings, and the length of every indexed chunk (zero where it has no terms)."""
    once = cut_lineage(chunking.first_per_chunk(chunks, ["source", "seq"]).select(*lexical.CHUNK_KEYS, "text"))
    postings = cut_lineage(lexical.packed_postings(once))
    counted = postings.select(*lexical.CHUNK_KEYS, "length")
    return postings, (once.select(*lexical.CHUNK_KEYS).join(counted, lexical.CHUNK_KEYS, "left")
                      .withColumn("length", F.coalesce("length", F.lit(0)).cast("bigint")))


def _embedded(chunks: DataFrame, model: dense.Model, name: str) -> DataFrame:
    return (dense.embed(chunks.select(*lexical.CHUNK_KEYS, "text"), model)
            .select("db", "scope", "source", "chunk_id", F.lit(name).alias("model"), F.col("vec").cast("array<double>").alias("vec")))
