"""Vector searches, chat repair and the pipeline against brute force."""

import random
from itertools import product

import numpy as np
import pytest

from pagequarry.llm import adaptive_scan, chat_repair, pivot_search

SCHEMA = "vec_id bigint, embedding array<float>, label int, score string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Rows and what takes part: (vec_id, vector) once each, by vector length."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(700, 12)).round(2)
    x[200:420] = x[200]
    x[500:600] = x[510] + rng.normal(size=(100, 12)) / 50
    rows = [(i, v.tolist(), None, "s") for i, v in enumerate(x)] + [(3, x[3].tolist(), 1, "s")] * 3
    rows += [(40, x[7].tolist(), 1, "s"), (11, (-x[7]).tolist(), 1, "s")]   # other vectors of known ids, one of them a query
    rows += [(i, rng.normal(size=5).tolist(), 1, "s") for i in range(2000, 2060)]
    odd = [(1000, None, 1, "s"), (1020, [1.0] * 11 + [None], 1, "s"), (1040, [float("nan")] * 12, 1, "s"), (1060, [float("inf")] * 12, 1, "s"),
           (1080, [], 1, "s"), (1101, [1.0, 2.0], 1, "s"), (None, x[0].tolist(), 1, "s"), (1120, [0.0] * 12, 1, "s")]
    return spark.createDataFrame(rows + odd, SCHEMA), {(i, tuple(np.array(v, np.float32).astype(float))) for i, v, *_ in rows + [odd[-1], odd[5]]}


def brute(points, k=20, change=lambda v: v):
    points = sorted({(i, tuple(change(np.array(v)))) for i, v in points})
    out = {}
    for i, q in points:
        if i % 20 == 0:
            others = [(j, v) for j, v in points if len(v) == len(q) and (j, v) != (i, q)]
            s = np.array([v for _, v in others]).reshape(len(others), len(q)) @ np.array(q)
            order = np.lexsort(([j for j, _ in others], -s))[:k]
            out.setdefault(i, []).append([(others[o][0], s[o]) for o in order])
    return out


def by_query(rows):
    """Per query id the rank lists of its vectors; several vectors of one id are told apart by nothing but their rows."""
    out = {}
    for r in rows:
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(v) for q, v in out.items()}


def ranked(found):
    return {q: sorted((n + 1, i, s) for hits in lists for n, (i, s) in enumerate(hits)) for q, lists in found.items() if any(lists)}


@pytest.mark.parametrize("block", [pivot_search.BLOCK, 60])
def test_exact_search(vectors, monkeypatch, block):
    monkeypatch.setattr(pivot_search, "BLOCK", block)
    frame, points = vectors
    assert by_query(pivot_search.top_k(frame).collect()) == ranked(brute(points, change=lambda v: np.floor(64 * v)))


def test_exact_search_skips_far_blocks(spark):
    """On vectors in groups most blocks are not visited, and the result is still exact."""
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(40, 8))[rng.integers(0, 40, 3000)] * 20 + rng.normal(size=(3000, 8))).round(2)
    pivots = pivot_search.choose_pivots(pivot_search.lifted(x, (x * x).sum(axis=1).max()), 16)
    table = pivot_search.distances(pivot_search.lifted(x, (x * x).sum(axis=1).max()), pivots)
    seen, uids = 0, np.arange(3000)
    for q in range(0, 3000, 100):
        reach = (x * x).sum(axis=1).max()
        counted = []

        class Counting(np.ndarray):
            def __getitem__(self, key):
                if isinstance(key, np.ndarray):
                    counted.append(len(key))
                return np.asarray(self)[key]
        found, values = pivot_search.search_block(uids, uids, x.view(Counting), table, x[q], q, x[q] @ x[q],
                                                  pivot_search.distances(pivot_search.as_queries(x[q:q + 1]), pivots)[0], reach, 20)
        scores = x @ x[q]
        scores[q] = -np.inf
        assert found.tolist() == np.lexsort((uids, -scores))[:20].tolist()
        seen += sum(counted)
    assert seen < 0.6 * 30 * 3000


@pytest.mark.parametrize("size", [200_000, 3_000_000, 2 ** 31])
def test_exact_search_of_large_vectors(spark, size):
    rng = np.random.default_rng(4)
    rows = [(i, [int(c) / 64 for c in rng.integers(-size * 64, size * 64, 6)]) for i in range(120)]
    whole = {i: [int(c * 64) for c in v] for i, v in rows}
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    if size == 2 ** 31:
        with pytest.raises(Exception, match="OverflowError|too large"):
            pivot_search.top_k(frame).collect()
        return
    got = by_query(pivot_search.top_k(frame).collect())
    for q in range(0, 120, 20):
        scores = sorted(((-sum(a * b for a, b in zip(whole[q], whole[i], strict=True)), i) for i in whole if i != q))[:20]
        assert got[q] == [(n + 1, i, -s) for n, (s, i) in enumerate(scores)]


def test_adaptive_scan(vectors, monkeypatch):
    monkeypatch.setattr(adaptive_scan, "CHUNK", 40)
    frame, points = vectors
    want = brute({(i, v) for i, v in points if any(v)})
    got = by_query(adaptive_scan.nearest(frame).collect())
    assert set(got) == set(ranked(want))
    hit = total = 0
    for q, lists in want.items():
        assert len(got[q]) == sum(map(len, lists))
        # Equal vectors tie, so what counts is how many results reach the true last score of some vector of the query.
        least = min(hits[-1][1] for hits in lists)
        hit += sum(s >= least - 1e-9 for _, _, s in got[q])
        total += len(got[q])
        if len(lists) == 1:
            mine = [np.array(v) for i, v in points if i == q]
            for _, i, s in got[q]:
                assert any(s == pytest.approx(m @ np.array(v)) for m in mine for j, v in points if j == i and len(v) == len(m))
    assert hit >= 0.9 * total


def test_adaptive_scan_probes_a_part(spark):
    """On many vectors a query looks at less than a third of the rows and finds nine of ten neighbours."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 24))
    x = base[rng.integers(0, 300, 12_000)] + rng.normal(size=(12_000, 24)) / 2
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    index = adaptive_scan.fit(x[rng.permutation(len(x))[:4096]], float((x * x).sum(axis=1).max()), len(x), 20)
    assert len(index.centroids) >= 100 and index.probes < len(index.centroids) / 3
    got, hit = by_query(adaptive_scan.nearest(frame, step=200).collect()), 0
    for q, found in got.items():
        scores = x @ x[q]
        scores[q] = -np.inf
        hit += len({i for _, i, _ in found} & set(np.argsort(-scores)[:20].tolist()))
    assert len(got) == 60 and hit >= 0.9 * 20 * 60


def test_small_and_empty_searches(vectors):
    frame, _ = vectors
    for search in (pivot_search.top_k, adaptive_scan.nearest):
        assert search(frame.where("vec_id < 0")).count() == 0 and search(frame.where("vec_id = 7")).count() == 0
        assert search(frame.where("vec_id = 20")).count() == 0
        assert len(search(frame.where("vec_id BETWEEN 20 AND 25")).collect()) == 5


def cheapest(kinds):
    """All ways to open, merge and insert, tried out."""
    legal = lambda seq: seq and seq[-1] == 3 and all(b in chat_repair.NEXT[a] for a, b in zip((0, *seq), seq))  # noqa: B905, E731
    runs = [r for n in range(3) for r in product((1, 2, 3), repeat=n)]
    best = 10 ** 9

    def go(i, seq, cost):
        nonlocal best
        if cost >= best:
            return
        if i == len(kinds):
            best = min([best, *(cost + 2 * len(t) for t in runs if legal((*seq, *t)))])
            return
        for r in (1, 2, 3):
            relabel = 3 * (kinds[i] != r)
            if seq and seq[-1] == r:
                go(i + 1, seq, cost + relabel + 1)
            for t in runs:
                go(i + 1, (*seq, *t, r), cost + relabel + 2 * len(t))
    go(0, (), 0)
    return best


def test_repair_is_cheapest():
    rng = random.Random(4)
    for _ in range(40):
        kinds = [rng.randrange(4) for _ in range(rng.randint(1, 3))]
        roles = [None if k == 0 else chat_repair.ROLES[k - 1] for k in kinds]
        rows = chat_repair.rows_of(1, range(len(kinds)), roles, ["t"] * len(kinds), chat_repair.path(kinds))
        assert sum(r[6] for r in rows) == cheapest(kinds)


def legal_rendering(text):
    roles = [part.split("\n")[0] for part in text.split("<|im_start|>")[1:]]
    kinds = [chat_repair.ROLES.index(r) + 1 for r in roles]
    assert text.count("<|im_end|>") == len(roles) and kinds[-1] == 3
    assert all(b in chat_repair.NEXT[a] for a, b in zip([0, *kinds], kinds))  # noqa: B905


def test_repair_tables(spark):
    rng = random.Random(9)
    roles = ["system", "user", "assistant", None, "tool"]
    rows = [(c, t, rng.choice(roles), rng.choice([None, "", "hi", "<|im_start|>system\nx"]), "z") for c in range(30) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "a", "z"), (None, None, "user", "b", "z")] + [(5, 3, "user", "same", "z")] * 40
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")
    rows += [(100 + c, t, rng.choice(roles), "m", "z") for c in range(25) for t in range(rng.randint(30, 45))]   # many ties
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, place string")
    totals = {}
    for long in (chat_repair.LONG, 5, 11):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(chat_repair, "LONG", long)
            out = chat_repair.repair(frame, long).collect()
        assert len(out) == len(rows)
        told = {}
        for r in sorted(out, key=lambda r: r.place):
            told.setdefault(r.conv_id, []).append(r)
        for found in told.values():
            assert [r.place for r in found] == list(range(len(found)))
            legal_rendering("".join(r.piece for r in found))
        totals[long] = sorted((repr((r.conv_id, r.place)), r.turn, r.action, r.role, r.inserted, r.cost, r.piece) for r in out)
    assert totals[chat_repair.LONG] == totals[5] == totals[11]
    assert chat_repair.repair(frame.where("conv_id < 0")).count() == 0


def test_pipeline_stages_on_awkward_rows(spark, tmp_path):
    """Nulls in every column, empty and long texts, copies, and an empty table go through every stage."""
    import corpus_pipeline
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `__text` string, size string"
    long = " ".join(f"word{i % 3001}" for i in range(60_000))
    rows = [(i, t, None if i % 2 else "en", None if i % 3 else "s", None if i % 4 else len(t or ""), "kept", "z") for i, t in enumerate(
        [None, "", " ", long, long, "a line that is shared by many texts\nown", "a line that is shared by many texts\nother", "a line that is shared by many texts", "x"] * 3)]
    rows += [rows[5], (None, "no number", None, None, None, None, None), (None, None, None, None, None, None, None)]
    spark.createDataFrame([(i, 1, 0) for i in range(0, 27, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for frame in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = corpus_pipeline.stored(stage(spark, frame, str(tmp_path)))
            if name != "packing":
                assert out.columns == frame.columns
                assert out.where("doc_id IS NOT NULL AND `__text` IS NULL").count() == 0
            # each stage also takes what its predecessor kept
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)))
            assert docs.count() <= 3 * frame.count() if name != "packing" else True
        assert (docs.count() > 0) == (frame.count() > 0)


def test_pipeline_stages(spark):
    import corpus_pipeline
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    before, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, before, folder))
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality", "near_dedup"):
            assert docs.exceptAll(before).count() == 0
        if name == "quality":
            good = before.join(labels.where("quality = 1"), "doc_id", "left_semi")
            assert good.join(docs, "doc_id", "left_semi").count() >= 0.95 * good.count()
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name != "packing":
            before = docs
    assert docs.selectExpr("count(DISTINCT doc_id)").first()[0] == before.selectExpr("count(DISTINCT doc_id)").first()[0]
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).select("doc_id", "start", "length", "ids_crc32").collect())) == \
        sorted(map(tuple, docs.select("doc_id", "start", "length", "ids_crc32").collect()))
