"""Entity resolution of pages: routing, same-topic groups, merging, contradictions.

``pages``: db, filename, type, title, key_terms and for merging body, sources and so on.
Pages are first collapsed to *topics* (type, sorted title keys) and *signatures* (topic,
key terms).  A title used by a billion pages is one row from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from pagequarry import fixed_values as fv
from pagequarry.functions import dates as dt
from pagequarry.functions import markup as mk
from pagequarry.functions import text as tx
from pagequarry.functions import words as wd
from pagequarry.session import cut_lineage, is_dealt, spread

_TOPIC = ["db", "type", "tokens"]


def with_topic(pages: DataFrame) -> DataFrame:
    """Adds ``tokens`` and ``terms``; the type is lower-cased, ``concept`` by default."""
    return (spread(pages).withColumn("type", mk.page_type(F.col("type")))
            .withColumn("tokens", wd.topic_tokens(F.coalesce("title", "filename")))
            .withColumn("terms", F.array_sort(F.array_distinct("key_terms"))))


def _rare_first(sets: DataFrame, keys: list[str], members: str) -> DataFrame:
    """Each set with its members ordered from rare to frequent."""
    each = sets.select(*keys, F.explode(members).alias("m"))
    counted = each.groupBy("db", "m").agg(F.count("*").alias("n"))
    return (each.join(counted, ["db", "m"]).groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("n", "m"))).alias("_s"))
            .withColumn("rare", F.transform("_s", lambda s: s["m"])).drop("_s"))


def _nested_topics(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of different topics of one type where one token set holds the other.

    The smaller set is looked up by its rarest token only, so a token found in a third of
    all titles leads only the few sets that consist of such tokens.
    """
    def contained(small: DataFrame, big: DataFrame, a: str, b: str) -> DataFrame:
        led = _rare_first(small.select(*_TOPIC), _TOPIC, "tokens").select(
            "db", "type", F.col("tokens").alias(a), F.get("rare", F.lit(0)).alias("token"))
        held = big.select("db", "type", F.col("tokens").alias(b), F.explode("tokens").alias("token"))
        return (led.join(held, ["db", "type", "token"])
                .where((F.size(a) < F.size(b)) & (F.size(F.array_except(a, b)) == 0))
                .select("db", "type", F.col("l"), F.col("r")))

    return contained(left, right, "l", "r").unionByName(contained(right, left, "r", "l"))


def nested_signatures(left: DataFrame, right: DataFrame, least: float = fv.TERM_OVERLAP) -> DataFrame:
    """db, type, l, l_terms, r, r_terms: nested topics whose key terms overlap enough.

    Overlap is over the smaller set, so a set of n terms must share one of any
    n - ceil(least * n) + 1 of its terms; the rarest ones are looked up.
    """
    ls = left.select(*_TOPIC, "terms").where(F.size("terms") > 0).distinct()
    rs = right.select(*_TOPIC, "terms").where(F.size("terms") > 0).distinct()
    topics = cut_lineage(_nested_topics(left.select(*_TOPIC).distinct(), right.select(*_TOPIC).distinct()))

    def side(sets: DataFrame, name: str, lead: bool) -> DataFrame:
        keys = [*_TOPIC, "terms"]
        if lead:
            n = F.size("terms")
            probe = n - F.ceil(n * least - 1e-9).cast("int") + 1
            rows = _rare_first(sets, keys, "terms").select(*keys, F.explode(F.slice("rare", F.lit(1), probe)).alias("term"))
        else:
            rows = sets.select(*keys, F.explode("terms").alias("term"))
        return rows.select("db", "type", F.col("tokens").alias(name), F.col("terms").alias(f"{name}_terms"), "term")

    def looked_up(lead_left: bool) -> DataFrame:
        a = topics.join(side(ls, "l", lead_left), ["db", "type", "l"])
        return a.join(side(rs, "r", not lead_left), ["db", "type", "r", "term"]) \
            .where(F.size("l_terms") <= F.size("r_terms") if lead_left else F.size("l_terms") > F.size("r_terms"))

    return (looked_up(True).unionByName(looked_up(False)).where(wd.overlap(F.col("l_terms"), F.col("r_terms")) >= least)
            .select("db", "type", "l", "l_terms", "r", "r_terms").distinct())


def _two_first(registry: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The two smallest file names per key (the second one where a page meets itself)."""
    least = registry.groupBy(*keys).agg(F.min("filename").alias("_1"))
    rest = registry.join(least, keys).where(F.col("filename") != F.col("_1")) \
        .groupBy(*keys).agg(F.min("filename").alias("_2"))
    return least.join(rest, keys, "left").withColumn(name, F.struct("_1", "_2")).drop("_1", "_2")


def _other(pair: Column, filename: Column) -> Column:
    return F.when(pair["_1"] != filename, pair["_1"]).otherwise(pair["_2"])


def route(new_pages: DataFrame, registry: DataFrame) -> DataFrame:
    """db, filename, ``target``: the existing page each new page belongs to, or NULL.

    An equal topic wins, else a nested topic with enough common key terms; of several
    the first by file name.  Types never mix.  Pages with an empty topic are not routed.
    """
    new, known = with_topic(new_pages), with_topic(registry).where(F.size("tokens") > 0)
    equal = _two_first(known, _TOPIC, "_equal")
    pairs = nested_signatures(new.where(F.size("tokens") > 0), known)
    first_known = _two_first(known, [*_TOPIC, "terms"], "_near") \
        .withColumnsRenamed({"tokens": "r", "terms": "r_terms"})
    near = (pairs.join(first_known, ["db", "type", "r", "r_terms"])
            .groupBy("db", "type", F.col("l").alias("tokens"), F.col("l_terms").alias("terms"))
            .agg(F.min(F.col("_near._1")).alias("_near")))
    # a page is never nested in its own topic, so no self test is needed there
    return (new.join(equal, _TOPIC, "left").join(near, [*_TOPIC, "terms"], "left")
            .withColumn("target", F.coalesce(_other(F.col("_equal"), F.col("filename")), F.col("_near")))
            .select("db", "filename", "type", "target"))


# --- connected components -----------------------------------------------------------------

def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component: the smallest node of each connected component (of nodes with edges).

    Alternates large-star and small-star steps: the number of rounds grows with the logarithm
    of the component size, not with its diameter; every round is written to the shared folder.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    seen = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
        floor = down.groupBy("u").agg(F.min("v").alias("m"))
        small = (down.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(floor.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        pairs = cut_lineage(small)
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def _topic_key() -> Column:
    return F.concat_ws("|", "db", "type", F.array_join("tokens", " "))


def topic_groups(pages: DataFrame) -> DataFrame:
    """db, filename, type, group: pages joined directly or in steps by the same-topic relation.

    Pages of one topic are one node; only topics are linked, through their signatures.
    """
    known = with_topic(pages).where(F.col("type").isin("concept", "entity"))
    full = known.where(F.size("tokens") > 0)
    pairs = nested_signatures(full, full)
    key = lambda side: F.concat_ws("|", "db", "type", F.array_join(side, " "))
    found = components(pairs.select(key("l").alias("a"), key("r").alias("b")))
    lone = F.concat_ws("|", F.lit("page"), "db", "filename")
    keyed = known.withColumn("node", F.when(F.size("tokens") > 0, _topic_key()).otherwise(lone))
    return (keyed.join(found, "node", "left")
            .select("db", "filename", "title", "type", F.size("tokens").alias("n_tokens"),
                    F.coalesce("component", "node").alias("group")))


def merge_plan(groups: DataFrame) -> DataFrame:
    """db, canonical, member: fewest title keys, then the shortest and first file name lead."""
    lead = groups.groupBy("db", "group").agg(
        F.min(F.struct("n_tokens", F.length("filename").alias("n"), "filename")).alias("lead"))
    return (groups.join(lead, ["db", "group"])
            .select("db", F.col("lead.filename").alias("canonical"), F.col("filename").alias("member")))


def summary_plan(pages: DataFrame) -> DataFrame:
    """db, canonical, member, base: one summary page per document, the longest page first."""
    mine = pages.where((F.lower(F.coalesce("type", F.lit(""))) == "source-summary") | F.col("filename").startswith("summary-"))
    keyed = mine.withColumn("canonical", F.concat(F.lit("summary-"), mk.summary_base(F.col("filename")), F.lit(".md")))
    base = keyed.groupBy("db", "canonical").agg(
        F.max_by("filename", F.struct(F.octet_length("body"), "filename")).alias("base"))
    return keyed.join(base, ["db", "canonical"]).select("db", "canonical", F.col("filename").alias("member"), "base")


# --- merging ----------------------------------------------------------------------------------

def page_lines(pages: DataFrame, keys: list[str], text: str = "body", blanks: Column | None = None) -> DataFrame:
    """One row per non-blank line under its heading: section number, line number, heading, line.

    Rows for which ``blanks`` holds keep their blank lines.
    """
    heading = rf"(?md)^#{{1,6}}[{tx.SPACE}].*$"
    mark = mk._MARK
    cut = F.split(F.regexp_replace(text, heading, mark + "$0"), mark, -1)
    sections = spread(pages).select(*keys, F.posexplode(cut).alias("section", "_s"))
    keep = F.lit(False) if blanks is None else blanks
    named = sections.select(*keys, "section", "_s").withColumn(
        "heading", F.when(F.col("section") > 0, tx.strip(F.get(mk.split_lines(F.col("_s")), F.lit(0)))).otherwise(""))
    return (named.select(*keys, "section", "heading", F.posexplode(mk.split_lines(F.col("_s"))).alias("line_no", "line"))
            .where(((~tx.is_blank(F.col("line")) | keep) & ((F.col("section") == 0) | (F.col("line_no") > 0)))
                   | ((F.col("section") > 0) & (F.col("line_no") == 0))))


def merged_lines(members: DataFrame, blanks: bool = False) -> DataFrame:
    """Union of the sections of a group of pages, as ordered rows; no fact is lost.

    ``members``: db, canonical, ord, body; ord 0 is the page the others are merged into.
    Sections of that page stay where they are; a heading it has more than once takes new lines
    at its last place.  A line of a later page is kept if no earlier section of the group has it;
    a section new to the group comes with all its lines.  Groups are never gathered: first occurrences
    are minima, pre-aggregated before their shuffle.  With ``blanks`` the first page keeps its blank lines.
    """
    rows = page_lines(members, ["db", "canonical", "ord"], blanks=F.col("ord") == 0 if blanks else None)
    group = ["db", "canonical"]
    at = F.struct("ord", "section")
    rows = rows.withColumn("at", at).withColumn("key", F.lower("heading")) \
        .withColumn("norm", tx.squeeze(F.lower(tx.strip(F.col("line")))))
    is_head = (F.col("section") > 0) & (F.col("line_no") == 0)
    first_section = rows.where(is_head).groupBy(*group, "key").agg(
        F.coalesce(F.max(F.when(F.col("ord") == 0, F.col("at"))), F.min("at")).alias("home"))
    first_line = rows.where(~is_head).groupBy(*group, "norm").agg(F.min("at").alias("line_at"))
    kept = (rows.join(first_section, [*group, "key"], "left").join(first_line, [*group, "norm"], "left")
            .withColumn("is_head", is_head)
            .withColumn("home", F.when(F.col("ord") == 0, F.col("at")).otherwise(F.col("home")))
            .withColumn("home", F.coalesce("home", F.struct(F.lit(0).alias("ord"), F.lit(0).alias("section"))))
            .where((F.col("ord") == 0)
                   | (F.col("is_head") & (F.col("home") == F.col("at")))
                   | (~F.col("is_head") & ((F.col("line_at") == F.col("at"))
                                           | ((F.col("key") != "") & (F.col("home") == F.col("at")))))))
    return kept.select(*group, "home", "ord", "section", "line_no", "line")


def merged_header(members: DataFrame, conflicts: DataFrame | None = None, today: Column | None = None) -> DataFrame:
    """Header fields of merged groups: ordered unions of lists, earliest creation date.

    ``members`` also carries sources, related, key_terms and created.  With ``conflicts`` (of
    :func:`merged_conflicts`) a group that has some gets ``confidence`` low; with ``today`` a group
    of several pages is updated on that day.
    """
    group = ["db", "canonical"]

    def union(field: str) -> DataFrame:
        each = members.select(*group, "ord", F.posexplode(field).alias("pos", "v")) \
            .withColumn("v", tx.strip(F.col("v"))).where("v <> ''")
        first = each.groupBy(*group, "v").agg(F.min(F.struct("ord", "pos")).alias("at"))
        return first.groupBy(*group).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias(field))

    out = members.groupBy(*group).agg(F.min("created").alias("created"), F.count("*").alias("n_pages"))
    for field in ("sources", "related", "key_terms"):
        if field in members.columns:
            out = out.join(union(field), group, "left").withColumn(field, F.coalesce(field, F.array().cast("array<string>")))
    if today is not None:
        out = out.withColumn("updated", F.when(F.col("n_pages") > 1, today))
    if conflicts is not None:
        low = conflicts.select(*group).distinct().withColumn("confidence", F.lit("low"))
        out = out.join(low, group, "left")
    return out


def merged_conflicts(members: DataFrame, today: Column) -> DataFrame:
    """db, canonical, ord, key, newer, sentence: what each page of a group contradicts when its turn comes.

    ``members``: db, canonical, ord, body, effective_date, updated, created; ord 0 is the page the
    others are merged into, one after the other.  A page contradicts the pages before it in a key
    for which they have values and it brings a new one.  Only the first page of every set of values
    counts, so copies are counted away before pages of a group meet.  The merged page has
    the date of its first page, and from the first merge on ``today`` unless it has an effective date.
    """
    group, fact = ["db", "canonical"], ["db", "canonical", "key"]
    pages = members.select(*group, "ord", F.struct(dt.page_date(F.col("effective_date"), F.col("updated"), F.col("created")).alias("date"),
                                                   F.col("effective_date").alias("effective")).alias("dated"), "body")
    # One way from the members to the result: they are read once, and rows that come dealt by their group stay where they lie.
    turns = mk.with_numeric_facts(pages if is_dealt(pages) else spread(pages), "body", "_f").groupBy(*group, "ord").agg(
        F.collect_list("dated").alias("dated"), F.flatten(F.collect_list("_f")).alias("_f"))
    # A turn without facts is kept, with no key: it may be the first or the second of its group.
    stated = turns.select(*group, "ord", "dated", F.explode_outer(mk.values_by_key(F.col("_f"))).alias("_k")).select(
        *fact[:2], F.col("_k.key").alias("key"), F.col("_k.values").alias("new"), "ord", "dated")
    sets = stated.groupBy(*fact, "new").agg(
        F.min("ord").alias("ord"), F.min_by("dated", "ord").alias("dated"), F.min(F.when(F.col("ord") > 0, F.col("ord"))).alias("second"),
        F.min(F.when(F.col("ord") == 0, F.array_min("dated"))).alias("base"))
    # The lists of a set go with the first of its values only.
    first = F.col("pos") == 0
    values = sets.select(*fact, "ord", "second", "base", "new", "dated", F.posexplode_outer("new").alias("pos", "value")) \
        .withColumn("new", F.when(first, F.col("new"))).withColumn("dated", F.when(first, F.col("dated")))
    # Windows in an order in which the exchange of the first and the sort of the one before serve the next.
    origin = F.asc_nulls_last("ord")
    whole = W.partitionBy(*group).orderBy("key", "value", origin).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    turn = W.partitionBy(*fact).orderBy("ord")
    before, by_then = turn.rangeBetween(W.unboundedPreceding, -1), turn.rangeBetween(W.unboundedPreceding, W.currentRow)
    fresh = F.when(F.row_number().over(W.partitionBy(*fact, "value").orderBy(origin)) == 1, F.col("value"))
    # The count says which rows contradict, so that a caller who wants no sentence pays for no lists.
    n_old = F.when(F.col("db").isNotNull() & F.col("canonical").isNotNull(), F.count("fresh").over(before))
    met = (values.withColumn("second", F.min("second").over(whole)).withColumn("base", F.min("base").over(whole)).where("key is not null")
           .withColumn("fresh", fresh).withColumn("old", F.collect_set("fresh").over(before)).withColumn("n_old", n_old)
           .withColumn("n", F.count("fresh").over(by_then)).where("pos = 0 and ord is not null and n_old > 0 and n > n_old")
           .select(*fact, "ord", "second", "base", "new", F.sort_array("old").alias("old"), F.explode("dated.date").alias("date")))
    known = F.when(F.col("ord") == F.col("second"), F.col("base.date")).otherwise(F.coalesce("base.effective", today))
    newer = dt.is_newer(F.col("date"), known)
    return met.select(*group, "ord", "key", newer.alias("newer"),
                      mk.conflict_sentence(F.struct("key", "old", "new"), newer).alias("sentence"))


def remap_related(pages: DataFrame, renamed: DataFrame) -> DataFrame:
    """Links re-pointed to the pages their targets were merged into; self links and repeats go."""
    each = pages.select("db", "filename", F.posexplode("related").alias("pos", "_r")) \
        .withColumn("member", tx.strip(F.col("_r")))
    moved = (each.join(renamed.select("db", "member", "canonical"), ["db", "member"], "left")
             .withColumn("to", F.coalesce("canonical", "member")).where("to <> '' and to <> filename"))
    first = moved.groupBy("db", "filename", "to").agg(F.min("pos").alias("pos"))
    lists = first.groupBy("db", "filename").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "to"))), lambda s: s["to"]).alias("related"))
    return (pages.drop("related").join(lists, ["db", "filename"], "left")
            .withColumn("related", F.coalesce("related", F.array().cast("array<string>"))))


def contradiction_rows(pairs: DataFrame) -> DataFrame:
    """Conflicts of every (old_text, new_text) pair; a newer date on the new side resolves them.

    ``pairs`` also carries old_date and new_date.  The comparison is inside the row.
    """
    return _conflicts(mk.with_numeric_facts(mk.with_numeric_facts(spread(pairs), "old_text", "_old"), "new_text", "_new"))


def contradictions_between(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """:func:`contradiction_rows` of two tables joined on ``on``; only facts are joined.

    ``old`` has old_text and old_date, ``new`` has new_text and new_date.  Facts are read once per
    distinct text, which costs far more than the exchange that finds the distinct ones, and are
    written before they are compared, so that the comparison does not repeat the patterns.
    """
    def facts(rows: DataFrame, text: str, name: str) -> DataFrame:
        found = cut_lineage(mk.with_numeric_facts(spread(rows.select(text).distinct()), text, name).where(F.size(name) > 0))
        return rows.join(found, text).drop(text)
    return _conflicts(facts(new, "new_text", "_new").join(facts(old, "old_text", "_old"), on))


def _conflicts(found: DataFrame) -> DataFrame:
    found = found.withColumn("_c", mk.contradictions(F.col("_old"), F.col("_new")))
    newer = dt.is_newer(F.col("new_date"), F.col("old_date"))
    keep = [c for c in found.columns if c not in ("old_text", "new_text", "_old", "_new", "_c")]
    return (found.select(*keep, F.explode("_c").alias("_c")).withColumn("newer", newer)
            .select(*keep, "newer", F.col("_c.key").alias("key"), F.col("_c.old").alias("old"), F.col("_c.new").alias("new"),
                    mk.conflict_sentence(F.col("_c"), F.col("newer")).alias("sentence")))
