"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagequarry.llm.common import shielded, stored, without
from pagequarry.session import bounded_broadcast

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
MAX_STEPS = 60
STEPS_PER_WRITE = 4
TOLERANCE = 1e-7
# Sums are taken over whole multiples of 1 / GRID, so that their order never shows.
GRID = 1024
BUCKETS = 4096
# Sources of at most so many open units are finished in one task each.
FEW = 4096
CUTS = "array<struct<gap:bigint,place:double,size:bigint>>"
ADDED = ("size", "source_size", "target", "copies")


def words(text: Column) -> Column:
    """Number of words (runs of other characters than the six blanks); null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """source, source_size, docs, target from rows of source, size.

    Sources in code point order (null last) take the weights in turn and share the total size by
    them.  A source stops at ``max_copies`` times its size, and the others share what it leaves:
    in the order of size per weight, the stopped ones come first, so one running sum finds them.
    """
    # Sources are shared out as two windows over one row per source.
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("docs"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1)) \
        .withColumn("room", F.col("source_size") * max_copies)
    order = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    total, rest = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    left = total - F.coalesce(F.sum("room").over(before), F.lit(0))
    share = left / (rest - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    leveled = weighted.withColumn("stopped", F.col("room") <= F.col("weight") * share).withColumn("total", total)
    level = ((F.col("total") - F.sum(F.when(F.col("stopped"), F.col("room")).otherwise(0)).over(everything))
             / F.sum(F.when(~F.col("stopped"), F.col("weight"))).over(everything))
    return leveled.select("source", "source_size", "docs", F.when(
        F.col("stopped"), F.col("room").cast("double")).otherwise(F.col("weight") * level).alias("target"))


def _exact_sum(value: Column) -> Column:
    return F.sum(F.round(value * GRID).cast("decimal(38,0)")).cast("double") / GRID


def _rate(tilt: Column, size: Column, mean: Column, max_copies: int) -> Column:
    return F.least(F.lit(float(max_copies)), F.exp(tilt * size / mean))


def tilts(sizes: DataFrame, goals: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """``goals`` with ``mean`` and ``tilt``: rates min(max, exp(tilt * size / mean)) meet the targets.

    Among all rates up to ``max_copies`` whose sizes add up to the target these are the nearest
    to one in relative entropy.  The dual has one convex problem per source; each Newton step is
    one aggregation over the counted sizes (source, size, count) for all sources at once.  A step
    that leaves the bracket of its source is replaced by the middle of the bracket.
    """
    counted = stored(sizes.where("size > 0").groupBy(F.col("source").alias("s"), "size").agg(F.count("*").alias("n")))
    mean = F.greatest(F.col("source_size") / F.greatest("docs", F.lit(1)), F.lit(1.0))
    full = F.col("target") >= F.col("source_size") * max_copies * (1 - 1e-12)
    high = F.col("mean") * F.log(F.lit(float(max_copies)))
    state = goals.withColumn("mean", mean).withColumn("done", full | (F.col("target") <= 0)) \
        .withColumn("tilt", F.when(full, high).otherwise(0.0)).withColumn("high", high) \
        .withColumn("low", F.least(F.lit(0.0), F.col("mean") * F.log(F.col("target") / F.col("source_size"))) - 1e-9)
    state = stored(state)
    for _ in range(MAX_STEPS // STEPS_PER_WRITE):
        if state.where("not done").isEmpty():
            break
        for _ in range(STEPS_PER_WRITE):
            state = _newton_step(state, counted, goals.columns, max_copies)
        state = stored(state)
    return state.select(*goals.columns, "mean", "tilt")


def _newton_step(state: DataFrame, counted: DataFrame, names: list[str], max_copies: int) -> DataFrame:
    rate = _rate(F.col("tilt"), F.col("size"), F.col("mean"), max_copies)
    tokens = F.col("n") * F.col("size") * rate
    # The state rides along as group columns: one use of it per step keeps the plan a chain.
    joined = (state.join(counted, F.col("source").eqNullSafe(F.col("s")), "left").groupBy(*state.columns)
              .agg(_exact_sum(tokens).alias("reached"),
                   _exact_sum(F.when(rate < max_copies, tokens * F.col("size") / F.col("mean"))).alias("slope")))
    gap = F.col("reached") - F.col("target")
    low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
    upper = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
    newton = F.col("tilt") - gap / F.nullif("slope", F.lit(0.0))
    inside = (newton > low) & (newton < upper)
    met = F.coalesce((F.abs(gap) <= F.col("target") * TOLERANCE) | (upper - low <= 1e-12), F.lit(False))
    return joined.select(
        *names, "mean", (F.col("done") | met).alias("done"),
        F.when(F.col("done") | met, F.col("tilt")).when(inside, newton).otherwise((low + upper) / 2).alias("tilt"),
        F.when(F.col("done"), F.col("high")).otherwise(upper).alias("high"),
        F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"))


def _with_rates(rows: DataFrame, tilted: DataFrame, max_copies: int) -> DataFrame:
    """``rows`` with target, whole and the place of their fraction (0 best, below 1 worst)."""
    per = tilted.select(F.col("source").alias("__source"), "source_size", "target", "mean", "tilt")
    joined = rows.join(bounded_broadcast(per), rows["source"].eqNullSafe(per["__source"])).drop("__source")
    rate = F.when(F.col("size") > 0, _rate(F.col("tilt"), F.col("size"), F.col("mean"), max_copies)).otherwise(F.lit(0.0))
    chance = F.shiftrightunsigned(F.xxhash64(F.lit("extra"), "doc_id"), 12) / F.lit(float(1 << 52))
    place = (1 - (F.col("__rate") - F.col("__whole") - chance)) / 2
    return (joined.withColumn("__rate", rate).withColumn("__whole", F.floor("__rate"))
            .withColumn("__place", F.when((F.col("size") > 0) & (F.col("__whole") < max_copies), F.least(place, F.lit(1 - 1e-9)))))


def _buckets(place: Column) -> tuple[Column, Column]:
    fine = F.floor(place * (BUCKETS * BUCKETS))
    return F.floor(fine / BUCKETS), F.pmod(fine, F.lit(BUCKETS))


def _taken(weight: str) -> Column:
    """Whether a cut has taken what is at (__place, size): it fitted when the cut began, and comes up to its end."""
    end = lambda c: (F.col("__place") < c["place"]) | ((F.col("__place") == c["place"]) & (F.col("size") <= c["size"]))
    return F.coalesce(F.exists("cuts", lambda c: (F.col(weight) <= c["gap"]) & end(c)), F.lit(False))


def _passed(rows: DataFrame, bucket: str) -> DataFrame:
    """s, gap, bucket, before: the first bucket where the running weight passes the gap, none if all fit."""
    sums = rows.groupBy("s", "gap", "before", bucket).agg(F.sum("weight").alias("weight"))
    run = F.col("before") + F.sum("weight").over(Window.partitionBy("s").orderBy(bucket))
    return stored(sums.withColumn("run", run).groupBy("s", "gap").agg(
        F.min(F.when(F.col("run") > F.col("gap"), F.struct(bucket, (F.col("run") - F.col("weight")).alias("before")))).alias("at"),
        F.max("run").alias("all")).select("s", "gap", f"at.{bucket}", F.coalesce("at.before", "all").alias("before")))


def _prefix(left: DataFrame) -> DataFrame:
    """s, rest, cuts: the longest run of units, in the order of their places, that fits the gap.

    Two histograms of at most BUCKETS rows per source, the second inside the bucket where the
    running weight of the first passes the gap, then the units of one bucket of the second.
    """
    one, two = _buckets(F.col("__place"))
    rows = left.select("s", "gap", "size", "weight", "__place", one.alias("one"), two.alias("two"))

    def inside(found: DataFrame, *buckets: str) -> DataFrame:
        at = found.where(F.col(buckets[-1]).isNotNull()).select(F.col("s").alias("t"), *[F.col(b).alias(f"at_{b}") for b in buckets], "before")
        same = [rows[b] == at[f"at_{b}"] for b in buckets]
        return rows.join(bounded_broadcast(at), [rows["s"].eqNullSafe(at["t"]), *same])

    first = _passed(rows.withColumn("before", F.lit(0).cast("long")), "one")
    second = _passed(inside(first, "one"), "two").join(first.select(F.col("s").alias("t"), "one"), F.col("s").eqNullSafe(F.col("t"))).drop("t")
    second = stored(second)
    run = F.col("before") + F.sum("weight").over(Window.partitionBy("s").orderBy("__place", "size"))
    last = (inside(second, "one", "two").withColumn("run", run).where("run <= gap").groupBy(F.col("s").alias("l"))
            .agg(F.max(F.struct(F.col("__place").alias("place"), "size", "run")).alias("last")))
    within = second.select(F.col("s").alias("w"), (F.col("one") / BUCKETS + F.col("two") / (BUCKETS * BUCKETS)).alias("place"),
                           F.col("before").alias("run"))
    ends = (first.join(within, F.col("s").eqNullSafe(F.col("w")), "left").join(last, F.col("s").eqNullSafe(F.col("l")), "left"))
    return ends.select("s", (F.col("gap") - F.coalesce("last.run", "run", "before")).alias("rest"), F.array(F.struct(
        "gap", F.coalesce("last.place", "place", F.lit(1.0)).alias("place"),
        F.coalesce("last.size", F.lit(0)).cast("long").alias("size"))).alias("more"))


def _greedy(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
    """The same cuts, one after the other, for the few units of one source."""
    units = units.sort_values(["__place", "size"])
    rest, found = int(units["gap"].iloc[0]), []
    fresh = True
    for place, size, weight in zip(units["__place"], units["size"], units["weight"], strict=True):
        if weight <= rest:
            if fresh:
                found.append({"gap": rest})
            found[-1] |= {"place": place, "size": size}
            rest, fresh = rest - weight, False
        else:
            # What does not fit ends a cut unless it was too large when the cut began.
            fresh = fresh or weight <= found[-1]["gap"]
    return pd.DataFrame({"s": [key[0]], "rest": [rest], "more": [found]})


def cuts(rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per source s its cuts; and the units (source, __place, size) that are passed over although one row of them would fit.

    Units are rows of one source, place and size: repeated rows get their extra copy together.
    In the order of their places all units are taken that still fit below the target.  A cut takes
    them up to the first that does not fit, and the next cut goes on with those that fit into the
    gap it leaves.  Places are spread by a hash, so the gap shrinks fast; the loop ends when no unit fits.
    """
    units = stored(rated.where("__place is not null").groupBy("source", "__place", "size").agg(F.count("*").alias("n"))
                   .withColumn("weight", F.col("n") * F.col("size")))
    limit = stored(rated.groupBy("source", "target").agg(F.sum(F.col("size") * F.col("__whole")).alias("whole")).select(
        F.col("source").alias("s"), F.floor(F.col("target") - F.col("whole")).alias("gap"), F.array().cast(CUTS).alias("cuts")))
    left = units
    while True:
        left = stored(left.join(bounded_broadcast(limit), F.col("source").eqNullSafe(F.col("s")))
                      .where((F.col("weight") <= F.col("gap")) & ~_taken("weight")).select(*units.columns, "s", "gap")).drop("s")
        each = stored(left.groupBy(F.col("source").alias("s")).agg((F.count("*") > FEW).alias("many")))
        if each.isEmpty():
            break
        parts = left.join(bounded_broadcast(each), F.col("source").eqNullSafe(F.col("s")))
        found = parts.where("not many").groupBy("s").applyInPandas(_greedy, limit.select("s", F.col("gap").alias("rest"), F.col("cuts").alias("more")).schema)
        if not each.where("many").isEmpty():
            found = found.unionByName(_prefix(parts.where("many")))
        found = found.withColumnRenamed("s", "f")
        limit = stored(limit.join(found, F.col("s").eqNullSafe(F.col("f")), "left").select(
            "s", F.coalesce("rest", "gap").alias("gap"), F.concat("cuts", F.coalesce("more", F.array().cast(CUTS))).alias("cuts")))
        left = left.drop("gap")
    odd = units.where("n > 1").join(bounded_broadcast(limit), F.col("source").eqNullSafe(F.col("s")))
    return limit, stored(odd.where(_taken("size") & ~_taken("weight")).select(
        F.col("source").alias("__o"), F.col("__place").alias("__at"), F.col("size").alias("__n")))


@shielded("mean", "tilt", "s", "gap", "cuts")
def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``copies`` (0 to ``max_copies``).

    Rates come from ``tilts``; each document gets the whole part of its rate as copies, and one
    more if the rest beats a hash of its doc_id by a margin that is set per source so that the
    copies stay below the target; after the margin come all documents that still fit the gap,
    until none does.  No randomness: reruns agree.


    Defined cases: a null or blank text has size 0 and no copy; a null source is a source, the
    last one; equal doc_ids share their hash, so repeated rows are treated alike; an empty table
    gives an empty table; other columns pass, columns named like the added ones are replaced.
    """
    plain = without(docs, ADDED).withColumn("size", words(F.col("text")))
    sizes = stored(plain.select("doc_id", "source", "size"))
    tilted = tilts(sizes, stored(targets(sizes, weights, max_copies)), max_copies)
    rated = _with_rates(sizes, tilted, max_copies)
    limit, odd = cuts(rated)
    every = _with_rates(plain, tilted, max_copies)
    marked = every.join(bounded_broadcast(limit), every["source"].eqNullSafe(limit["s"]), "left").withColumn("__extra", _taken("size"))
    if not odd.isEmpty():
        same = F.col("source").eqNullSafe(F.col("__o")) & (F.col("__place") == F.col("__at")) & (F.col("size") == F.col("__n"))
        marked = marked.join(bounded_broadcast(odd), same, "left").withColumn("__extra", F.col("__extra") & F.col("__at").isNull())
    return (marked.withColumn("copies", (F.col("__whole") + F.col("__extra").cast("long")).cast("long"))
            .select(*without(docs, ADDED).columns, *ADDED))


@shielded("mean", "tilt", "s", "gap", "cuts")
def copied(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it has copies."""
    mixed = mix(docs, **options).where("copies > 0")
    return (mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
