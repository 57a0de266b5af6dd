"""Line dedup: lines that several documents share stay in one of them only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import BLANKS, UPPER, shielded, stored, text_hash, without

ADDED = ("n_lines", "n_dropped")
# A key of so many lines, and at least one in HOT_SHARE of all lines, is hot; so at most HOT_SHARE keys are.
HOT_LINES, HOT_SHARE = 1000, 50_000


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, UPPER.lower())


@shielded()
def drop_shared_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with ``text`` less its shared lines, and ``n_lines`` (before) and ``n_dropped``.

    A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses all its
    lines except those of the largest doc_id that holds it.  Lines are exploded as two hashes
    (128 bits), once, counted per key after a count per document, and only positions come back.
    Keys of very many lines, of which there are few whatever the input, are marked where the lines
    are; the lines of the other keys meet their key in one exchange.

    Defined cases: a null or empty text is one empty line and becomes the empty text; rows of one
    doc_id are one document for the count; equal rows lose the same lines; a null doc_id counts
    as one document and never keeps a key; an empty table gives an empty table; other columns
    pass unchanged, but columns named like the added ones are replaced.
    """
    base = (without(docs, ADDED)
            .withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
            .withColumn("__row", text_hash(F.coalesce("text", F.lit("")), 1)))
    lines = stored(base.select("doc_id", "__row", F.posexplode("__lines").alias("pos", "line"))
                   .where(F.char_length("line") >= min_chars)
                   .withColumn("key", line_key(F.col("line")))
                   .where(F.char_length("key") >= min_chars)
                   .select("doc_id", "__row", "pos", text_hash(F.col("key"), 1).alias("h1"), text_hash(F.col("key"), 2).alias("h2")))
    shared = stored(lines.groupBy("h1", "h2", "doc_id").agg(F.count("*").alias("n"))
                    .groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"), F.sum("n").alias("n"))
                    .where(F.col("docs") >= min_docs).select("h1", "h2", "keeper", "n"))
    least = max(HOT_LINES, -(-lines.count() // HOT_SHARE))
    hot = shared.where(F.col("n") >= least).select("h1", "h2", F.struct("keeper").alias("hot"))
    told = lines.join(F.broadcast(hot), ["h1", "h2"], "left")
    place = [F.col("doc_id").alias("__id"), F.col("__row").alias("__r"), "pos"]
    other = lambda keeper: ~F.col("doc_id").eqNullSafe(F.col(keeper))
    frequent = told.where(F.col("hot").isNotNull() & other("hot.keeper")).select(*place)
    rest = (told.where(F.col("hot").isNull()).drop("hot").join(shared.where(F.col("n") < least), ["h1", "h2"])
            .where(other("keeper")).select(*place))
    drops = frequent.unionByName(rest).groupBy("__id", "__r").agg(F.sort_array(F.collect_set("pos")).alias("__drop"))
    joined = base.join(drops, base["doc_id"].eqNullSafe(drops["__id"]) & (base["__row"] == drops["__r"]), "left")
    # Runs of lines between dropped positions: linear in the lines, whatever their number.
    edges = F.concat(F.array(F.lit(-1)), F.col("__drop"), F.array(F.size("__lines")))
    runs = F.transform(F.sequence(F.lit(1), F.size("__edges") - 1), lambda j: F.array_join(
        F.slice(F.col("__lines"), F.element_at("__edges", j) + 2, F.element_at("__edges", j + 1) - F.element_at("__edges", j) - 1), "\n"))
    # A run without lines (two dropped neighbours) must not leave an empty line behind.
    filled = F.filter(F.sequence(F.lit(1), F.size("__edges") - 1),
                      lambda j: F.element_at("__edges", j + 1) - F.element_at("__edges", j) > 1)
    kept = F.array_join(F.transform(filled, lambda j: F.element_at("__runs", j)), "\n")
    return (joined.withColumn("__edges", edges).withColumn("__runs", F.when(F.col("__drop").isNotNull(), runs))
            .withColumn("text", F.when(F.col("__drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept))
            .withColumn("n_lines", F.size("__lines").cast("long"))
            .withColumn("n_dropped", F.coalesce(F.size("__drop"), F.lit(0)).cast("long"))
            .select(*without(docs, ADDED).columns, *ADDED))
