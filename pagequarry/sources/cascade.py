"""Deleting sources from every stored table: manifest, chunks, postings, lengths, vectors, questions, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.operators import pages as pg
from pagequarry.session import cut_lineage
from pagequarry.sources.snapshots import SnapshotTable
from pagequarry.sources.tables import KnowledgeStore


def delete_everywhere(gone: DataFrame, store: KnowledgeStore, manifest: SnapshotTable, pages: SnapshotTable, today: Column) -> DataFrame:
    """db, table, removed: the sources of ``gone`` (db, source) leave every table.

    The manifest (key db, filename, sha256) loses the first entry of each name, the store all rows of the sources,
    and the pages follow :func:`pages.cascade_delete`; the index rows of removed pages go with them.
    Tables change one after the other and each change may be repeated, so a job that dies is run again.
    """
    gone = cut_lineage(gone.select("db", "source").distinct())
    listed = manifest.read()
    kept = pg.deregister(listed, gone.select("db", F.col("source").alias("filename")))
    dropped = cut_lineage(listed.join(kept, list(manifest.keys), "left_anti"))
    before = pages.read()
    left, removed = pg.cascade_delete(before, gone, today)
    removed = cut_lineage(removed)
    changed = left.join(before.select("db", "filename", F.col("updated").alias("_before")), ["db", "filename"]) \
        .where(~F.col("updated").eqNullSafe(F.col("_before"))).select(*before.columns)
    all_sources = gone.unionByName(removed.select("db", F.col("filename").alias("source")))
    held = [t.counted().join(all_sources, ["db", "source"], "left_semi").groupBy("db").agg(F.lit(name).alias("table"), F.sum("n").alias("removed"))
            for name, t in store.tables().items() if t.exists()]
    told = [dropped.groupBy("db").agg(F.lit("manifest").alias("table"), F.count("*").alias("removed")),
            removed.groupBy("db").agg(F.lit("pages").alias("table"), F.count("*").alias("removed")), *held]
    counts = told[0]
    for more in told[1:]:
        counts = counts.unionByName(more)
    counts = cut_lineage(counts)
    pages.merge(cut_lineage(changed), gone=removed)
    manifest.merge(listed.limit(0), gone=dropped)
    store.delete(all_sources)
    return counts
