"""Work per task is bounded by counted sizes, and changes of stored tables touch what they must."""

from pathlib import Path

from pyspark.sql import functions as F

from pagequarry.functions import markup as mk
from pagequarry.operators import dense, lexical, resolve
from pagequarry.plans import page_queries, search_queries
from pagequarry.session import spread_read
from pagequarry.sources.tables import KnowledgeStore

CHUNK = "db string, scope string, source string, chunk_id string, text string"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _chunks(spark, n=60):
    words = "alpha beta gamma delta süße_größe x_1 Ⅷ ı".split()
    rows = [("d", "raw", f"s{i}", f"c{i}", " ".join(words[(i + j) % 8] for j in range(i % 11))) for i in range(n)]
    return spark.createDataFrame([*rows, ("d", "raw", "s1", "c1", "alpha again"), ("d", "raw", None, None, None), (None, "raw", "e", "e", "beta")], CHUNK)


def _asked(spark):
    return spark.createDataFrame([("q1", "d", "alpha gamma"), ("q2", "d", "beta süße_größe again")], "query_id string, db string, text string")


def test_words_are_counted_where_their_text_was_dealt(spark):
    chunks = _chunks(spark).withColumn("scope", F.lit("raw"))   # a constant key
    wanted = F.broadcast(lexical.asked_terms(_asked(spark)).select("term").distinct().withColumn("asked", F.lit(True)))
    whole = _plan(lexical.packed_postings(chunks))
    some = _plan(lexical.packed_postings(chunks, wanted))
    assert whole.count("Exchange hashpartitioning(_bucket") == 1 == whole.count("Exchange hashpartitioning")
    assert some.count("Exchange hashpartitioning(_bucket") == 1


def test_tasks_follow_the_matches_and_results_do_not(spark, monkeypatch):
    def found():
        return sorted((r.query_id, r.rank, r.chunk_id, r.score, r.matched_terms) for r in lexical.search(_chunks(spark), _asked(spark), 7).collect())
    usual = found()
    monkeypatch.setattr(lexical, "MATCHES_PER_TASK", 3)
    monkeypatch.setattr(lexical, "BYTES_PER_TASK", 50)
    assert len(usual) == 14 and found() == usual
    asked = lexical.asked_terms(_asked(spark))
    scored = lexical.score(lexical.build_postings(_chunks(spark)), asked)
    matches = scored.count()
    assert scored.rdd.getNumPartitions() >= max(matches // 3, spark.sparkContext.defaultParallelism)


def test_texts_of_one_task_are_not_held_to_be_sorted(spark, monkeypatch):
    chunks = _chunks(spark).coalesce(1)
    docs, asked = _contained(spark)
    usual = sorted(map(str, lexical.packed_postings(chunks).withColumn("found", F.sort_array("found")).collect()))
    inside = sorted(map(str, search_queries.containing_documents(docs, asked).collect()))
    monkeypatch.setattr(lexical, "BYTES_PER_TASK", 50)
    monkeypatch.setattr(lexical, "unsorted_partitions", lambda spark: 3)
    packed = lexical.packed_postings(chunks)
    lines = [line for line in _plan(packed).splitlines() if "Exchange hashpartitioning(_bucket" in line]
    assert len(lines) == 2 and ", 3)" in lines[1] and ", 3)" not in lines[0]
    assert sorted(map(str, packed.withColumn("found", F.sort_array("found")).collect())) == usual
    assert sorted(map(str, search_queries.containing_documents(docs, asked).collect())) == inside
    assert len(inside) == 9


def test_texts_are_embedded_in_tasks_of_counted_bytes(spark, monkeypatch):
    chunks = _chunks(spark).repartition(8).cache()     # as many partitions as cores, which may all lie in one row group

    def vectors():
        return sorted(repr((r.source, r.chunk_id, r.text, r.vec)) for r in dense.embed(chunks).collect())

    usual = vectors()
    monkeypatch.setattr(lexical, "BYTES_PER_TASK", 50)
    many = dense.embed(chunks)
    assert many.columns == [*chunks.columns, "vec"] and many.rdd.getNumPartitions() > 20 and vectors() == usual
    monkeypatch.setattr(dense, "unsorted_partitions", lambda spark: 12)
    some = dense.embed(chunks)
    assert some.rdd.getNumPartitions() == 12 and vectors() == usual
    # the text is not sent twice, and no row is held to be sorted
    plan = _plan(some.drop("text")).split("Exchange hashpartitioning(", 1)[1]
    assert plan.startswith("db") and "RoundRobin" not in plan.split("InMemoryTableScan")[0] and "text#" not in plan.split(", 12)")[0]


def _contained(spark):
    docs = [("c1", "zero alpha beta gamma end"), ("c2", "alpha beta gamma"), ("c3", "gamma beta alpha"), ("c4", None), (None, "x alpha beta gamma y"),
            ("c2", "alpha beta gamma"), ("c5", "the of")]
    asked = [("q1", "alpha beta gamma"), ("q2", "the of"), ("q3", None), ("q4", "beta")]
    return spark.createDataFrame(docs, "chunk_id string, text string"), spark.createDataFrame(asked, "query_id string, text string")


def test_texts_do_not_move_to_few_candidates(spark, monkeypatch):
    docs, asked = _contained(spark)
    docs, asked = docs.cache(), asked.unionByName(asked.where("query_id = 'q1'"))     # a query id may repeat
    few = search_queries.containing_documents(docs, asked)
    inside = sorted(map(str, few.collect()))
    moved = [line for line in _plan(few).splitlines() if "Exchange hashpartitioning(chunk_id" in line]
    assert len(inside) == 12 and not moved
    monkeypatch.setattr(search_queries, "is_small", lambda rows: False)
    monkeypatch.setattr(lexical, "BYTES_PER_TASK", 5)
    monkeypatch.setattr(lexical, "unsorted_partitions", lambda spark: 3)
    many = search_queries.containing_documents(docs, asked)
    dealt = [line for line in many._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in line]
    assert [line.rsplit(", ", 1)[1] for line in dealt[:2]] == ["20", "3"] and sorted(map(str, many.collect())) == inside


def test_a_task_is_one_bucket_and_sends_its_best_once(spark, monkeypatch):
    monkeypatch.setattr(lexical, "MATCHES_PER_TASK", 3)
    asked = lexical.asked_terms(_asked(spark))
    scored = lexical.score(lexical.build_postings(_chunks(spark)), asked).withColumn("task", F.spark_partition_id())
    per_task = scored.groupBy("task").agg(F.count_distinct(lexical.BUCKET).alias("n")).collect()
    assert len(per_task) > 1 and {r.n for r in per_task} == {1}


def test_packed_rows_hold_the_postings(spark):
    made = lexical.build_postings(_chunks(spark))
    rows = {(r.source, r.term): (r.tf, r.length) for r in made.rows.collect()}
    # c1 has two rows of text: beta, and alpha again
    mine = [v for k, v in rows.items() if k[0] == "s1"]
    assert {("s1", t) for t in ("beta", "alpha", "again")} <= set(rows) and {length for _, length in mine} == {sum(tf for tf, _ in mine)}
    assert made.rows.columns == [*lexical.CHUNK_KEYS, "length", "term", "tf"]
    corpus = {r.db: r.n_rows for r in made.corpus.collect()}
    assert corpus == {"d": 62, None: 1}


def test_characters_beyond_ascii_are_looked_up(spark):
    from pagequarry.functions.unicode_forms import _plain_class, has_other_folds
    texts = ["", "plain", "größe é", "Ⅷ", "abǄ", "\U0001d4d0x", "ı", "Å"] + [chr(c) for c in (0xbc, 0x132, 0x149, 0x1f1, 0x622, 0x3000, 0xac00)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    old = (F.length("t") < F.octet_length("t")) & F.col("t").rlike(f"[^{_plain_class()}]")
    assert df.where(has_other_folds(F.col("t")) != old).count() == 0 and df.where(old).count() > 2


def test_a_change_of_the_store_handles_packed_rows(spark, tmp_path):
    store = KnowledgeStore(spark, f"{tmp_path}/store", buckets=8)
    rows = [("d", "raw", f"s{i}", 0, f"c{i}", f"word{i} shared text") for i in range(12)]
    store.build(spark.createDataFrame(rows, "db string, scope string, source string, seq int, chunk_id string, text string"))
    assert store.postings.packed().count() == 12 and store.postings.read().count() == 48   # shared is also found as shar
    files = {p for p in Path(f"{tmp_path}/store/postings").rglob("*.parquet")}
    first = store.postings._stored().where("source = 's0'").first()["bucket"]
    same = [r.source for r in store.postings._stored().where(F.col("bucket") == first).select("source").collect()]
    gone = spark.createDataFrame([("d", s) for s in same] + [("d", "never stored"), (None, "s5")], "db string, source string")
    store.delete(gone)
    left = {p for p in Path(f"{tmp_path}/store/postings").rglob("*.parquet")}
    # the emptied bucket is gone, buckets without a named source were not written again
    assert not list(Path(f"{tmp_path}/store/postings").rglob(f"bucket={first}/*.parquet"))
    named = {first} | {r.b for r in gone.select(F.pmod(F.xxhash64("source"), F.lit(8)).alias("b")).collect()}
    assert {p for p in files if int(p.parent.name.split("=")[1]) not in named} == {p for p in left if int(p.parent.name.split("=")[1]) not in named}
    assert {r.source for r in store.chunks.read().collect()} == {f"s{i}" for i in range(12)} - set(same)
    counts = {(r.table): r.removed for r in store.reset(spark.createDataFrame([("d",)], "db string")).collect()}
    n = 12 - len(same)
    assert counts == {"chunks": n, "postings": 4 * n, "lengths": n}


def test_conflicts_read_their_members_once(spark):
    rows = [("d", "a", 0, "weight 5 kg", None, "2020-01-01", None), ("d", "a", 1, "weight 6 kg, weight 6 kg", None, "2021-01-01", None),
            ("d", "a", 2, "weight 5 kg", None, "2022-01-01", None), ("d", "a", 3, "weight 7 kg and weight 6 kg", "2019-01-01", None, None),
            ("d", "a", 3, "weight 8 kg", None, None, None), ("d", "b", 0, "weight 5 kg", None, None, None), ("d", None, 1, "weight 5 kg", None, None, None)]
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text):
        seen.add(1)
        return text

    members = spark.createDataFrame(rows, "db string, canonical string, ord int, body string, effective_date string, updated string, created string") \
        .withColumn("body", read("body"))
    for c in ("effective_date", "updated", "created"):
        members = members.withColumn(c, F.col(c).cast("date"))
    out = resolve.merged_conflicts(members, F.lit("2020-06-01").cast("date")).collect()
    assert seen.value == len(rows)
    assert sorted((r.ord, r.sentence) for r in out) == [
        (1, "weight: now 6 kg per the newer source; previously 5 kg"),
        *[(3, "weight: sources disagree — 5 kg, 6 kg vs 6 kg, 7 kg, 8 kg (unresolved)")] * 2]


def test_sections_of_a_page_are_cut_once(spark):
    texts = ["no section", None, "## A\none\n## a \none longer\n## B\nx", "lead\n## A\n\nsame\n##  a\nsame\n## A\n\xa0same\u3000\n", "## A\n \n## A\n\n## B", "## A\n"]
    out = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, b string").withColumn("c", mk.collapse_sections(F.col("b")))
    out = out.select("i", "c.body", "c.removed")
    assert _plan(out).count("(?md)^##[") == 2 and _plan(out).count("sequence(0, ") == 1
    assert sorted((r.i, r.body, r.removed) for r in out.collect()) == [
        (0, "no section", 0), (1, None, 0), (2, "## a \none longer\n## B\nx", 1), (3, "lead\n## A\n\nsame\n", 2), (4, "## A\n \n## B", 1), (5, "## A\n", 0)]


def test_rows_of_one_row_group_are_dealt(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(4000).select(F.col("id").alias("i"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/one")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        read = spark.read.parquet(f"{tmp_path}/one")
        assert read.rdd.getNumPartitions() > cores and read.select(F.spark_partition_id()).distinct().count() == 1
        dealt = spread_read(read, "i")
        assert dealt.groupBy(F.spark_partition_id()).count().count() == cores and sorted(dealt.collect()) == sorted(read.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert spread_read(dealt, "i") is dealt


def test_conflicts_move_line_items_once(spark, tmp_path):
    lines = [(o, p, 3 + o % 3, 1, float(q), "A", "F", f"1995-0{o}-01 00:00:00") for p, qs in ((1, (5, 6, 5, 7)), (2, (5, 5)), (None, (1, 2)))
             for o, q in enumerate(qs, 1)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_returnflag string, "
                                 "l_linestatus string, day string").withColumn("l_shipdate", F.to_timestamp("day")).write.parquet(f"{tmp_path}/lineitem.parquet")
    out = page_queries.merged_conflicts(spark, str(tmp_path))
    moved = [line for line in _plan(out).splitlines() if "Exchange " in line]
    assert len(moved) == 1 and "hashpartitioning(canonical" in moved[0]
    assert sorted((r.canonical, r.ord, r.sentence) for r in out.collect()) == [
        ("part-1", 1, "weight: now 6 kg per the newer source; previously 5 kg"),
        ("part-1", 3, "weight: sources disagree — 5 kg, 6 kg vs 7 kg (unresolved)")]


def test_conflicts_of_pages_that_share_a_turn(spark):
    rows = [("d", "a", 0, "no measure", "2020-02-01"), ("d", "a", 2, "weight 5 kg", "2020-01-01"), ("d", "a", None, "weight 9 kg", None),
            ("d", "a", 4, "weight 6 kg and length 5 km", "2020-07-01"), ("d", "a", 4, "length 6 km", None), ("d", "a", 5, "weight 6 kg, length 6 km", None),
            ("d", "a", 6, "length 5 km, weight 6 kg, length 7 km", None), (None, "a", 0, "weight 5 kg", None), (None, "a", 1, "weight 6 kg", None)]
    members = spark.createDataFrame(rows, "db string, canonical string, ord int, body string, day string").select(
        "db", "canonical", "ord", "body", F.col("day").cast("date").alias("effective_date"), F.lit(None).cast("date").alias("updated"), F.lit(None).cast("date").alias("created"))
    found = {}
    for n, dealt in enumerate((members, members.repartition(4, "db", "canonical"))):
        out = resolve.merged_conflicts(dealt, F.lit("2020-06-01").cast("date"))
        assert _plan(out).count("- Exchange ") == (3, 1)[n]
        found[n] = sorted((r.ord, r.key, r.sentence) for r in out.collect())
    disagree = "weight: sources disagree — 5 kg, 9 kg vs 6 kg (unresolved)"
    assert found[0] == found[1] == [
        (2, "weight|kg", "weight: sources disagree — 9 kg vs 5 kg (unresolved)"), (4, "weight|kg", "weight: now 6 kg per the newer source; previously 5 kg, 9 kg"),
        (4, "weight|kg", disagree), (6, "length|km", "length: sources disagree — 5 km, 6 km vs 5 km, 7 km (unresolved)")]


def test_values_are_told_by_key(spark):
    facts = [[("b", "2"), ("a", "1"), ("b", "1"), ("b", "2"), (None, "3")], [], None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(facts)], "i int, f array<struct<key:string,value:string>>")
    got = {r.i: r.v and [tuple(x) for x in r.v] for r in df.select("i", mk.values_by_key(F.col("f")).alias("v")).collect()}
    assert got == {0: [(None, ["3"]), ("a", ["1"]), ("b", ["1", "2"])], 1: [], 2: None}


def test_measures_are_looked_for_twice(spark):
    texts = ["Weight 5,5 KG, length\ufdd0 7 days\ufdd1 and 3%x", "12.5kg6km", "\ufdd0", "", None, "dose 3 µSv5 mm"]
    out = mk.with_numeric_facts(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string"), "body", "facts")
    assert out.columns == ["i", "body", "facts"] and _plan(out).count("mSv") == 2
    assert {r.i: r.facts and [tuple(f) for f in r.facts] for r in out.collect()} == {
        0: [("weight|kg", "5.5 kg"), ("length|days", "7 days"), ("and|%", "3 %")], 1: [("kg|km", "6 km")], 2: [], 3: [], 4: None,
        5: [("sv|mm", "5 mm")]}
