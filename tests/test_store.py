"""The stored tables and streaming ingest, against one build of the same documents."""

from pagequarry.sources.tables import KnowledgeStore
from pagequarry.streaming.ingest import ingest_stream

DOCS = "db string, source string, version int, text string"


def _feed(spark, store, folder, *batches):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(DOCS).parquet(f"{folder}/in")
        ingest_stream(stream, store, f"{folder}/progress").awaitTermination()


def _texts(store):
    return {(r.db, r.source): r.text for r in store.chunks.read().collect()}


def test_an_older_version_never_replaces_a_newer_one(spark, tmp_path):
    store = KnowledgeStore(spark, f"{tmp_path}/store", buckets=2)
    _feed(spark, store, tmp_path, [("d", "a", 2, "red fox"), ("d", "b", 1, "blue whale")], [("d", "a", 1, "grey wolf")],
          [("d", "b", 3, "green frog"), ("d", "b", 2, "old frog")])
    found = _texts(store)
    assert {k: v.strip() for k, v in found.items()} == {("d", "a"): "red fox", ("d", "b"): "green frog"}
    asked = spark.createDataFrame([("q1", "d", "fox"), ("q2", "d", "frog"), ("q3", "d", "wolf whale")], "query_id string, db string, text string")
    assert {(r.query_id, r.source) for r in store.search(asked).collect()} == {("q1", "a"), ("q2", "b")}
    store.delete(spark.createDataFrame([("d", "a")], "db string, source string"))
    assert set(_texts(store)) == {("d", "b")}


def test_a_store_without_vectors_and_questions_stays_lexical(spark, tmp_path):
    from pagequarry.operators.dense import letter_model
    store = KnowledgeStore(spark, f"{tmp_path}/store", buckets=2)
    store.replace(spark.createDataFrame([("d", "a", "red fox"), ("007", "a", "red wolf")], "db string, source string, text string"),
                  letter_model, "letters")
    asked = spark.createDataFrame([("q", "d", "fox")], "query_id string, db string, text string")
    one = spark.createDataFrame([("d", "a")], "db string, source string")
    assert not store.has_vectors("letters") and not store.search_vectors(asked, letter_model, "letters").count()
    assert store.delete_questions(one).count() == 0
    store.build_vectors(letter_model, "letters")
    assert [r.source for r in store.search_vectors(asked, letter_model, "letters").collect()] == ["a"]
    gone = {(r.db, r.table): r.removed for r in store.reset(one.select("db")).collect()}
    assert gone == {("d", "chunks"): 1, ("d", "postings"): gone["d", "postings"], ("d", "lengths"): 1, ("d", "vectors"): 1}
    assert {r.db for r in store.chunks.read().collect()} == {"007"} and not store.search(asked).count()


def test_databases_with_names_that_folders_escape(spark, tmp_path):
    from pagequarry.sources.tables import SourceTable
    table = SourceTable(spark, f"{tmp_path}/t", buckets=2)
    names = ["plain", "a:b", "c=d", "e/../f", "100%", "", None, "kept"]
    table.write(spark.createDataFrame([(n, s) for n in names for s in ("x", "y", "z")], "db string, source string"))
    # Spark reads an empty partition value back as null
    table.replace(spark.createDataFrame([("a:b", s) for s in ("x", "y", "z")] + [("100%", "x")], "db string, source string"))
    found = sorted(((r.db or "", r.source) for r in table.read().collect()))
    assert ("100%", "y") in found and ("100%", "x") not in found and not [f for f in found if f[0] == "a:b"]
    table.drop(spark.createDataFrame([(n,) for n in names if n != "kept"], "db string"))
    assert {r.db for r in table.read().collect()} == {"kept"}


def test_snapshots(spark, tmp_path):
    import pytest
    from pyspark.sql import functions as F

    from pagequarry.sources.snapshots import ChangeRejected, ConcurrentChange, SnapshotTable
    table = SnapshotTable(spark, f"{tmp_path}/t", ("k",), buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "k string, v int")
    values = lambda df: {r.k: r.v for r in df.collect()}
    assert not table.exists()
    assert table.write(rows(*((f"k{i}", i) for i in range(20)))) == 1
    first = table.read()
    assert table.merge(rows(("k1", 100), ("new", 7)), gone=rows(("k2", 0))) == 2
    second = table.read()
    want = {f"k{i}": i for i in range(20) if i != 2} | {"k1": 100, "new": 7}
    assert values(second) == want and values(first) == {f"k{i}": i for i in range(20)} == values(table.read(1))
    # a check that finds problems, and a writer that dies, leave the old snapshot
    with pytest.raises(ChangeRejected):
        table.merge(rows(("k3", -1)), check=lambda df: df.where("v < 0"))
    with pytest.raises(Exception, match="dies"):
        table.merge(rows(("k3", -1)).withColumn("v", F.raise_error(F.lit("dies")).cast("int")))
    assert table.version() == 2 and values(table.read()) == want
    # of two writers that saw the same version one is told to repeat
    rival = SnapshotTable(spark, f"{tmp_path}/t", ("k",), buckets=4)
    seen = rival._state()
    table.merge(rows(("k5", 55)))
    rival._state = lambda version=None: seen
    outcomes = []
    try:
        rival.merge(rows(("k6", 66)))
    except ConcurrentChange:
        outcomes.append("lost")
    now = values(table.read())
    assert (now["k5"], now["k6"]) == ((55, 6) if outcomes else (5, 66))
    # every row may go
    assert table.merge(rows(), gone=table.read()) == 4 and table.read().count() == 0 and table.read().columns == ["k", "v"]
    assert table.merge(rows(("again", 1))) == 5 and values(table.read()) == {"again": 1}
