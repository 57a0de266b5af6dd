"""Operators on small inputs, against values worked out by hand or by plain loops."""

import random
import re
import unicodedata
from html.parser import HTMLParser

import oracle_check
import pytest
from pyspark.sql import functions as F

from pagequarry.functions import dates, rules, unicode_forms
from pagequarry.functions.words import explode_words, term_key, word_forms
from pagequarry.operators import chunking, dense, fusion, graph, lexical, pages, resolve
from pagequarry.plans import catalog
from pagequarry.sources import files

SMALL = "/root/testdata/sf0.001"


def test_word_forms(spark):
    want = {"rückstände": ["rückstände", "ruckstande", "rueckstaende", "ruckstand"], "straße": ["straße", "strasse", "straß"],
            "realization": ["realization", "realizatio"], "doses": ["doses", "dose"], "dose": ["dose"], "ﬁnal": ["ﬁnal", "final"]}
    df = explode_words(spark.createDataFrame([(w,) for w in want], "w string"), F.col("w"), ["w"])
    got = {r[0]: r[1] for r in df.select("w", word_forms(F.col("token"), F.col("folded"), F.col("stemmed"))).collect()}
    assert got == want


def test_term_keys(spark):
    df = spark.createDataFrame([(w,) for w in ("llms", "densing", "boss", "does", "experts")], "w string")
    assert [r[0] for r in df.select(term_key(F.col("w"))).collect()] == ["llm", "dens", "boss", "doe", "expert"]


def test_plain_characters_fold_one_to_one():
    plain = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: "\\U%08x" % int(m[1], 16), unicode_forms._plain_class()) + "]")
    table = unicode_forms._fold_table()
    for code in range(0x80, 0x3000):
        c = chr(code)
        if plain.match(c) and unicodedata.category(c)[0] in "LN" and c == c.lower():
            assert unicode_forms.fold(c) == table.get(c, c)


def test_packing_by_hand():
    packed = lambda *ps: [p["text"] for p in chunking.pack_paragraphs("\n\n".join(ps))]
    a, b, c = "a" * 2500, "b" * 2500, "c" * 200
    assert packed(c) == [c] and packed(a, c) == [a + "\n\n" + c]
    assert packed(a, b) == [a, a + "\n\n" + b]


def test_packing_covers_in_order_with_small_overlaps():
    rng = random.Random(7)
    for _ in range(200):
        parts = [f"{i}:" + "x" * rng.choice([1, 50, 290, 310, 900, 2500, 5000]) for i in range(rng.randint(1, 25))]
        runs = [[int(p.split(":")[0]) for p in w["text"].split("\n\n")] for w in chunking.pack_paragraphs("\n\n".join(parts))]
        size = lambda run: sum(len(parts[i]) + 2 for i in run)
        assert all(run == list(range(run[0], run[-1] + 1)) for run in runs)
        assert runs[0][0] == 0 and runs[-1][-1] == len(parts) - 1
        for left, right in zip(runs, runs[1:]):  # noqa: B905
            shared = [i for i in right if i <= left[-1]]
            assert shared and shared[-1] == left[-1] and size(shared[1:]) < 300
            assert size(shared) >= 300 or shared == left
            assert size([*left, left[-1] + 1]) > 4000


def test_repeated_chunk_ids(spark):
    rows = [("d", "raw", f"s{i:02}", "same" if i < 40 else f"c{i}", "red fox") for i in range(50)]
    chunks = spark.createDataFrame(rows, "db string, scope string, source string, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "d", "fox")], "query_id string, db string, text string")
    found = [r.chunk_id for r in lexical.search(chunks, asked, 10, matched_terms=False).orderBy("rank").collect()]
    assert len(found) == 10 == len(set(found))
    near = dense.nearest(dense.embed(chunks), dense.embed(asked), 12).collect()
    assert [r["rank"] for r in sorted(near, key=lambda r: r["rank"])] == list(range(12))


def test_batched_model_overflow(spark):
    def embed(texts):
        if sum(map(len, texts)) > 3000:
            raise ValueError("input exceeds the Maximum Context of this model")
        return [[float(len(t)), 1.0] for t in texts]
    rows = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([10, 2900, 2900, 9000, 5])], "i int, text string").coalesce(1)
    out = {r.i: r.v[0] for r in rows.select("i", dense.batched_model(embed)(F.col("text")).alias("v")).collect()}
    assert {k: out[k] for k in (0, 1, 2, 4)} == {0: 10, 1: 2900, 2: 2900, 4: 5} and out[3] <= 3000


def test_merge_keeps_base_sections_in_place(spark):
    base = "# A\none\n\n## N\nfirst\n\n## M\nmiddle\n\n## N\nlast"
    rows = [("d", "p", 0, base), ("d", "p", 1, "## N\nnew line\n\n## X\nonly here\n\n## M\nmiddle")]
    out = resolve.merged_lines(spark.createDataFrame(rows, "db string, canonical string, ord int, body string")).collect()
    lines = [r.line for r in sorted(out, key=lambda r: (r.home.ord, r.home.section, r.ord, r.section, r.line_no))]
    assert lines == ["# A", "one", "## N", "first", "## M", "middle", "## N", "last", "new line", "## X", "only here"]


def test_cascade_delete_by_name_prefix(spark):
    rows = [("d", "a.md", ["rep.pdf [Teil 1/2]", "rep"], ["b.md"], "old"), ("d", "b.md", ["report.md", "other"], ["a.md"], "old"),
            ("d", "c.md", [], ["a.md"], "old"), ("e", "f.md", ["rep"], [], "old")]
    frame = spark.createDataFrame(rows, "db string, filename string, sources array<string>, related array<string>, updated string")
    left, removed = pages.cascade_delete(frame, spark.createDataFrame([("d", "rep")], "db string, source string"), F.lit("now"))
    assert [r.filename for r in removed.collect()] == ["a.md"]
    assert {r.filename: (r.sources, r.related, r.updated) for r in left.collect()} == {
        "b.md": (["other"], [], "now"), "c.md": ([], [], "now"), "f.md": (["rep"], [], "old")}


def test_pieces_hold_the_whole_text():
    rng = random.Random(3)
    for _ in range(50):
        text = "\n\n".join("y" * rng.randint(0, 60) for _ in range(40))
        pieces = chunking.cut_points(text, 100)
        assert "".join(pieces) == text and max(map(len, pieces)) <= 100


def test_dates():
    assert str(dates.read_date("am 1. März 2021")) == "2021-03-01"
    assert dates.read_date("vom 31.02.2020, dann 2020-01-01") is None
    assert dates.read_date("kein Datum") is None


def test_html_text(spark):
    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.parts = []

        def handle_data(self, data):
            self.parts.append(data)

    rows = spark.read.parquet(f"{SMALL}/pages.parquet").select("html", files.html_text("html").alias("t")).collect()
    for html, text in rows:
        plain = Plain()
        plain.feed(html)
        assert text == " ".join(plain.parts)


def test_conditions(spark):
    df = spark.createDataFrame([(5, "abc", None)], "n int, s string, m int")
    for tree, want in (({"op": ">", "fact": "n", "value": 4}, True), ({"op": ">", "fact": "m", "value": 4}, False),
                       ({"op": "not", "arg": {"op": ">", "fact": "m", "value": 4}}, True), ({"op": "and", "args": []}, True),
                       ({"op": "or", "args": []}, False), ({"op": "<", "fact": "s", "value": 4}, False),
                       ({"op": "in", "fact": "n", "value": [1, 5]}, True), ({"op": "what"}, False)):
        assert rules.evaluate(df, tree).first()["passed"] is want


def test_components(spark):
    edges = [(str(i), str(i + 1)) for i in range(10, 20)] + [("30", "31"), ("31", "32")]
    got = {r[0]: r[1] for r in resolve.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[str(i)] for i in range(10, 21)} == {"10"} and got["32"] == "30"


def test_clique_guard(spark):
    rows = [("d", f"p{i}", "big") for i in range(9)] + [("d", "p1", "small"), ("d", "p2", "small")]
    got = graph.source_siblings(spark.createDataFrame(rows, "db string, filename string, source string")).collect()
    assert {(r["src"], r["dst"]) for r in got} == {("p1", "p2"), ("p2", "p1")}


def test_fusion_without_dense_hits_keeps_bm25(spark):
    docs = spark.createDataFrame([("d", "raw", "a", "1", "strahlen schutz"), ("d", "raw", "b", "2", "schutz gesetz")],
                                 "db string, scope string, source string, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "d", "Schutz Strahlen")], "query_id string, db string, text string")
    lex = lexical.search(docs, asked)
    none = lex.where(F.lit(False)).select("query_id", "db", "chunk_id", "scope", "source", "rank", "score")
    rows = fusion.fuse(lex, none).orderBy("rank").collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [(r["chunk_id"], r["score"]) for r in lex.orderBy("rank").collect()]


@pytest.mark.parametrize("name", ["bm25_topk", "dense_topk", "exact_dedup", "new_vs_registered", "link_graph", "linked_pages",
                                  "topic_route", "merged_lines", "contradictions", "cascade_delete", "condition_trace", "markdown_chunks"])
def test_oracle(spark, name):
    con = oracle_check.connect(SMALL)
    assert oracle_check.compare(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name]) is None


def test_short_passages_find_their_documents(spark):
    from pagequarry.plans.search_queries import containing_documents
    docs = spark.createDataFrame([("1", "a red fox ran"), ("2", "infrared foxes"), ("3", "the grey wolf of the wood")], "chunk_id string, text string")
    asked = spark.createDataFrame([("a", "red fox"), ("b", "the grey wolf of"), ("c", "x"), ("d", "of the")], "query_id string, text string")
    assert sorted(map(tuple, containing_documents(docs, asked).collect())) == [("a", "1"), ("a", "2"), ("b", "3"), ("c", "1"), ("c", "2"), ("d", "3")]
