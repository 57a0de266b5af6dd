"""Who may read and maintain which database.  users: username, dbs, maintains, is_admin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def listing(users: DataFrame) -> DataFrame:
    return users.orderBy("username")


def may_read(users: DataFrame, asked: DataFrame) -> DataFrame:
    """asked: username, db.  Unknown users may do nothing; an admin is no maintainer by that."""
    known = asked.join(users, "username", "left")
    return known.select("username", "db", F.coalesce(F.array_contains("dbs", F.col("db")), F.lit(False)).alias("reads"),
                        F.coalesce(F.array_contains("maintains", F.col("db")), F.lit(False)).alias("maintains"),
                        F.coalesce("is_admin", F.lit(False)).alias("is_admin"))


def grant_maintainer(users: DataFrame, grants: DataFrame) -> DataFrame:
    """A maintainer can also read: the granted databases join both sorted lists."""
    given = grants.groupBy("username").agg(F.collect_set("db").alias("_new"))
    rows = users.join(given, "username", "left")
    def grown(c: str):
        return F.when(F.col("_new").isNull(), F.col(c)).otherwise(F.array_sort(F.array_union(c, "_new"))).alias(c)
    return rows.select("username", grown("dbs"), grown("maintains"), "is_admin")


def backfill_maintainers(users: DataFrame) -> DataFrame:
    """Users from before the maintainer layer: admins maintain what they read, others nothing."""
    empty = F.array().cast("array<string>")
    return users.withColumn("maintains", F.when(F.col("maintains").isNotNull(), F.col("maintains"))
                            .when(F.col("is_admin"), F.col("dbs")).otherwise(empty))


def add_users(users: DataFrame, new: DataFrame) -> DataFrame:
    """Adds users whose name is free (an existing name is left as it is)."""
    return users.unionByName(new.join(users.select("username"), "username", "left_anti"))


def delete_users(users: DataFrame, names: DataFrame) -> DataFrame:
    return users.join(names.select("username"), "username", "left_anti")


def set_list(users: DataFrame, changes: DataFrame, column: str) -> DataFrame:
    """Replaces ``dbs`` or ``maintains`` of known users (changes: username, value)."""
    return (users.join(changes.withColumnRenamed("value", "_v"), "username", "left")
            .withColumn(column, F.coalesce("_v", column)).drop("_v"))


def after_events(users: DataFrame, events: DataFrame) -> DataFrame:
    """The users after an ordered table of changes: seq, op, username, dbs, maintains, is_admin.

    ``add`` works for a free name only, ``delete``, ``set_dbs``, ``set_maintains`` and ``grant`` (the first
    of dbs, into both sorted lists) for a known one; all others change nothing.  What a user is
    depends on a few places alone: the last delete, the first add after it, the last set of each
    list after that, and the grants after those.  They are minima and maxima, so the events of a user are never
    gathered; only the different databases granted to one user are.
    """
    first = F.lit(-1).cast("bigint")
    base = users.select("username", first.alias("seq"), F.lit("add").alias("op"), "dbs", "maintains", "is_admin")
    rows = base.unionByName(events.select("username", F.col("seq").cast("bigint").alias("seq"), "op", "dbs", "maintains", "is_admin"))
    at = lambda op: F.when(F.col("op") == op, F.col("seq"))
    gone = rows.groupBy("username").agg(F.max(at("delete")).alias("gone"))
    # A delete of an unknown user changes nothing, but neither does it hide an add before it: there is none.
    open_ = rows.join(gone, "username").where(F.col("gone").isNull() | (F.col("seq") > F.col("gone"))).drop("gone")
    born = open_.where("op = 'add'").groupBy("username").agg(
        F.min_by(F.struct("seq", "dbs", "maintains", "is_admin"), "seq").alias("b"))
    later = open_.join(born.select("username", F.col("b.seq").alias("since")), "username").where("seq > since").drop("since")
    last = later.groupBy("username").agg(
        F.max_by(F.when(F.col("op") == "set_dbs", F.struct("seq", "dbs")), at("set_dbs")).alias("sd"),
        F.max_by(F.when(F.col("op") == "set_maintains", F.struct("seq", "maintains")), at("set_maintains")).alias("sm"))
    granted = (later.where("op = 'grant'").select("username", "seq", F.get("dbs", F.lit(0)).alias("db"))
               .groupBy("username", "db").agg(F.max("seq").alias("seq"))
               .join(last, "username").groupBy("username").agg(
                   F.collect_set(F.when(F.col("sd").isNull() | (F.col("seq") > F.col("sd.seq")), F.col("db"))).alias("gd"),
                   F.collect_set(F.when(F.col("sm").isNull() | (F.col("seq") > F.col("sm.seq")), F.col("db"))).alias("gm")))
    state = born.join(last, "username", "left").join(granted, "username", "left")

    def held(stated, given):
        stated = F.coalesce(stated, F.array().cast("array<string>"))
        return F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, F.array_sort(F.array_union(stated, given))).otherwise(stated)
    return state.select("username", held(F.when(F.col("sd").isNotNull(), F.col("sd.dbs")).otherwise(F.col("b.dbs")), F.col("gd")).alias("dbs"),
                        held(F.when(F.col("sm").isNotNull(), F.col("sm.maintains")).otherwise(F.col("b.maintains")), F.col("gm")).alias("maintains"),
                        F.coalesce("b.is_admin", F.lit(False)).alias("is_admin"))
