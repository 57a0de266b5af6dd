"""Text operators against brute force, on ordinary and on awkward rows."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pagequarry.llm import bwt_dedup, line_dedup, mixing, packing, pii, quality, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_lines string, `key` string, size string, spans int, score string"
LONG = " ".join(f"word{i * i % 977}" for i in range(4000))
PASSAGE = "".join(chr(97 + i * i % 23) for i in range(150))
TEXTS = [None, "", " \n\t", "a", LONG, LONG, LONG.replace("word9", "word8", 3), PASSAGE + " x", "y " + PASSAGE, PASSAGE[:120] + "\n" + PASSAGE,
         "Shared line of more than twenty.\nown one", " shared LINE of more than twenty. ", "x\nShared line of more than twenty.\n\ny", "ééé " * 60,
         "one <|endoftext|> two<|endoftext|>", "mail a.b@c.de or +44 20 7946 0958, card 4111 1111 1111 1111 ip 10.0.0.255", "x" * 3000, "aaaa@" * 30, "1" * 400, "\0 \x85"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"src{i % 3}", None if i % 4 == 0 else len(t or ""),
             "n", "k", "s", i, "c") for i, t in enumerate(TEXTS)]
    rows += [rows[10], rows[10], (None, LONG, None, "src1", 5, "n", "k", "s", 1, "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


def test_empty_tables(docs):
    none = docs.where("doc_id < -1")
    assert line_dedup.drop_shared_lines(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert packing.pack(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_first(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.copied(none).count() == 0
    assert bwt_dedup.drop_repeats(none).count() == 0
    machine = quality.train(none, none.selectExpr("doc_id", "1 AS quality"))
    assert quality.classify(docs, machine).where("score BETWEEN 0 AND 1").count() == docs.count()


@pytest.mark.parametrize("hot", [line_dedup.HOT_LINES, 1])
def test_lines(docs, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT_LINES", hot)
    blanks = " \t\n\x0b\x0c\r"
    rows = texts_of(docs)
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s.strip(blanks))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(i)
    shared = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(v) >= 3}
    assert shared
    want = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in shared or shared[key(x)] == i]
        want.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    found = line_dedup.drop_shared_lines(docs)
    got = [tuple(r) for r in found.select("doc_id", "text", "n_lines", "n_dropped").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and "score" in found.columns


def brute_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    found = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) < 256 for x in m[0].split("."))]
    found += [("card", m) for m in re.finditer(r"[0-9]([ -]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", m) for m in re.finditer(r"\+[0-9][ ().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15]
    return [(k, m.start(), m.end()) for k, m in found]


def test_personal_data(docs):
    for r in pii.find_personal_data(docs).select("text", "spans").collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE_KINDS] == brute_spans(r.text or "")
    rng = np.random.default_rng(3)
    for _ in range(3000):
        t = "".join(rng.choice(list("a.@-+1 (2)%é59"), 40))
        assert [(k, a, b) for k, a, b, _ in pii.find_all(t) if k in pii.BASE_KINDS] == brute_spans(t)


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    kinds = lambda t: [s[0] for s in pii.find_all(t)]
    assert kinds("account GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("my SSN is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 020 7946 0958") == ["local_phone"] and kinds("id 020 7946 0958") == []


def test_ibans_before_capitals_and_numbers():
    found = lambda t: [t[a:b] for k, a, b, _ in pii.find_all(t) if k == "iban"]
    german, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for after in ("", " BIC COBADEFFXXX", " 12 Euro", " I am", " X", ", BIC", " " + british):
        assert found(f"IBAN {german}{after}") == [german, *[british] * (british in after)]
        assert found(f"A {british}{after}")[0] == british
    assert found(f"AB12 {german} and {british}") == [german, british]
    assert found(f"DE89 {german} x") == [german] and found(f"{german}12 Euro") == [] and found("DE88 3704 0044 0532 0130 00 BIC") == []
    assert found("NO93 8601 1117 947 SWIFT and MT84 MALT 0110 0001 2345 MTLC AST0 01S BIC") == ["NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"]


def test_packing(docs):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(packing.default_paths()[1])
    rows = packing.pack(docs, length=64).collect()
    whole = {}
    for r in rows:
        whole.setdefault(r.doc_id, []).append(r)
    for i, t in texts_of(docs):
        if i in (10, None):
            continue
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 0]
        pieces = sorted(whole[i], key=lambda r: r.start)
        assert sum((np.frombuffer(r.ids, "<u4").tolist() for r in pieces), []) == ids
        assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces[:-1])]).tolist()
    tape = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in tape:
        assert r.sequence_id * 64 + r.offset == at and r.offset + r.length <= 64
        at += r.length
    assert len(whole[10]) == 3 * len({r.start for r in whole[10]}) or len(whole[10]) >= 3


@pytest.mark.parametrize("text", ["a  b", " a", "a ", "x\n y", "x \n\n z  ", "it's 12 o'clock\t\tnow", "é è", "q" * 5000 + " w", "    a"])
def test_pieces_of_a_text(text):
    from tokenizers import Tokenizer
    paths = packing.default_paths()
    assert np.frombuffer(packing.ByteBPE(*paths)(text), "<u4").tolist() == Tokenizer.from_file(paths[1]).encode(text, add_special_tokens=False).ids


def brute_fingerprint(t):
    words = [w for w in re.split("[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]).encode(), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def test_covering_triples():
    triples = simhash.covering_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(four) for t in triples) for four in combinations(range(8), 4))


def test_near_duplicates(docs):
    rows = texts_of(docs)
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    got = sorted(((r.doc_id, r.fingerprint) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted(((i, f"{f:016x}") for i, f in prints), key=repr)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert len({f for _, f in prints}) >= kept.count() > 0


def test_links_of_random_fingerprints(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 62, 40)
    fps = {int(s) ^ sum(1 << int(b) for b in rng.integers(0, 62, rng.integers(0, 4))) for s in seeds for _ in range(12)} | {0, (1 << 61) | 3}
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for (i, a), (j, b) in combinations(rows, 2):
        if (a ^ b).bit_count() <= 4:
            parent[max(find(i), find(j))] = min(find(i), find(j))
    want = {f: find(i) for i, f in rows}
    for block in (simhash.BLOCK, 4):
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = simhash.near_classes(spark.createDataFrame(rows, "doc_id bigint, fp bigint")).collect()
        assert {r.fp: r.component_id for r in got} == want and len(got) == len(rows)


def test_mixing(docs):
    mixed = mixing.mix(docs).select("doc_id", "source", "size", "source_size", "target", "copies")
    rows = mixed.collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, mixed.collect()))
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert 0 <= r.copies <= 3
    names = [*sorted(s for s in sizes if s is not None), None]
    weights = {s: (1, 2, 3)[n % 3] for n, s in enumerate(names)}
    free, share = set(names), 0.0
    while True:
        share = (sum(sizes.values()) - sum(3 * sizes[s] for s in names if s not in free)) / sum(weights[s] for s in free)
        over = {s for s in free if weights[s] * share > 3 * sizes[s]}
        if not over:
            break
        free -= over
    for r in rows:
        want = weights[r.source] * share if r.source in free else 3 * sizes[r.source]
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want)
    assert mixing.copied(docs).count() == sum(r.copies for r in rows)


def test_clashing_names_come_back(docs):
    """Columns named like the operators' own inner ones pass through every pipeline stage unchanged."""
    names = ["__text", "__rate", "__lines", "__row", "__drop", "__fp", "__copy", "__place", "mean", "S", "gap", "line", "h1", "rows", "hot"]
    clash = docs.select("doc_id", "text", "source", "n_chars", *[F.concat(F.lit(f"keep {n} "), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(n) for n in names])
    for operator in (line_dedup.drop_shared_lines, simhash.keep_first, mixing.mix, mixing.copied):
        out = operator(clash)
        assert out.columns[:len(clash.columns)] == clash.columns
        rows = out.collect()
        assert rows and all(r[n] == f"keep {n} {-1 if r.doc_id is None else r.doc_id}" for r in rows for n in names)
    assert packing.pack(clash).count() > 0


def test_mixing_meets_targets(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('s', id % 4) AS source", "repeat('w ', cast(1 + (id * 37) % 91 AS int)) AS text")
    for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("copies") * F.col("size")).alias("n")).collect():
        assert abs(r.n - r.t) <= 0.002 * r.t


@pytest.mark.parametrize("few", [mixing.FEW, 0])
def test_mixing_fills_up_beside_long_documents(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW", few)
    docs = spark.range(24 * 300).selectExpr("id AS doc_id", "if(id % 24 = 23, null, concat('s', id % 24)) AS source",
                                            "repeat('w ', cast(if(id < 24, 20000, 80 + (id * 37) % 21) AS int)) AS text")
    docs = docs.unionByName(docs.where("doc_id % 5 = 0")).repartition(3)
    marks = mixing.mix(docs).select("doc_id", "source", "target", "size", "copies").collect()
    alike = {}
    for r in marks:
        alike.setdefault((r.doc_id, r.source), []).append(r)
    assert all(len({r.copies for r in same}) == 1 for same in alike.values())
    for source in {r.source for r in marks}:
        rows = [r for r in marks if r.source == source]
        gap = rows[0].target - sum(r.copies * r.size for r in rows)
        least = min(r.copies for r in rows if r.size < 200)
        free = [sum(r.size for r in same) for (_, s), same in alike.items() if s == source and same[0].size < 200 and same[0].copies == least]
        assert 0 <= gap and (len({r.copies for r in rows if r.size < 200}) == 1 or gap < min(free))


def brute_repeats(rows):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - 99):
            if data[s:s + 100] in seen:
                gone[s:s + 100] = True
            seen.add(data[s:s + 100])
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((i, hashlib.sha256(kept).hexdigest(), len(data), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [bwt_dedup.HOT, 3, 1])
def test_repeats(docs, spark, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT", hot)
    rng = np.random.default_rng(8)
    base = "".join(rng.choice(list("abcdefgh "), 900))
    made = [(100 + i, "".join(rng.choice(list("xyz"), rng.integers(0, 60))) + base[(a := rng.integers(0, 700)):a + rng.integers(90, 300)]
             + ("é" if i % 3 else "") + base[:rng.integers(0, 130)]) for i in range(60)]
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string")).repartition(4).cache()
    got = [(r[0], r[1], *r[2:]) for r in bwt_dedup.drop_repeats(frame).select(
        "doc_id", F.sha2("kept", 256), "n_bytes", "n_removed", "n_spans").collect()]
    assert sorted(got, key=repr) == brute_repeats(texts_of(frame))


def test_repeats_of_a_table_split_otherwise_each_time(spark, monkeypatch, tmp_path):
    key, sizes, keep = "spark.sql.files.maxPartitionBytes", ["1m", "1k"] * 10, bwt_dedup.stored
    rows = [(i, f"{i} {PASSAGE} {i % 3} " + "x" * i) for i in range(40)]
    spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8, "doc_id").write.parquet(f"{tmp_path}/t")

    def other_splits(df):
        out = keep(df)
        spark.conf.set(key, sizes.pop())
        return out
    monkeypatch.setattr(bwt_dedup, "stored", other_splits)
    try:
        got = bwt_dedup.drop_repeats(spark.read.parquet(f"{tmp_path}/t")).select("doc_id", F.sha2("kept", 256), "n_bytes", "n_removed", "n_spans").collect()
    finally:
        spark.conf.unset(key)
    assert sorted(map(tuple, got), key=repr) == brute_repeats(rows)


def test_slices_of_a_long_text(monkeypatch):
    monkeypatch.setattr(bwt_dedup, "SLICE", 500)
    parts = [p for held in bwt_dedup._slices([LONG.encode(), b"", b"y" * 101]) for p in held]
    covered = [(i, at + s) for i, at, part in parts for s in range(len(part) - 99)]
    assert len(covered) == len(set(covered)) == len(LONG) - 99 + 2


def test_run_length_index_is_smaller_than_its_text():
    texts = bwt_dedup.Contexts.of([PASSAGE.encode()] * 40)
    index = bwt_dedup.build(texts, np.zeros(40, np.int64))
    assert index.lengths.sum() == len(texts.data) and len(index.heads) < len(texts.data) / 10


@pytest.mark.parametrize("letters", [b"ab", b"abcd\0\xff"])
def test_matching_statistics(letters):
    rng = np.random.default_rng(4)

    def drawn(n):
        return rng.choice(np.frombuffer(letters, np.uint8), n).tobytes()

    def some(n):
        return [base[(a := rng.integers(0, 50)):a + rng.integers(1, 30)] + drawn(rng.integers(0, 12)) for _ in range(n)]

    base = drawn(60)
    indexed, streamed = some(15), some(20)
    own, asked = rng.integers(0, 3, 15), rng.integers(0, 4, 20)
    texts, known = bwt_dedup.Contexts.of(streamed), bwt_dedup.Contexts.of(indexed)
    source, length = bwt_dedup.matching_statistics(bwt_dedup.build(known, own), texts, asked)
    for part, block, begin in zip(streamed, asked, texts.begins, strict=True):
        rivals = [t for t, b in zip(indexed, own, strict=True) if b == block]
        for i in range(len(part)):
            n = max((k for k in range(len(part) - i + 1) if any(part[i:i + k] in t for t in rivals)), default=0)
            assert length[begin + i] == n
            assert known.data[source[begin + i]:][:n].tobytes() == part[i:i + n]


def test_repeats_of_a_bucket_of_many_contexts():
    rng = np.random.default_rng(5)

    def drawn(letters, n):
        return rng.choice(np.frombuffer(letters, np.uint8), n).tobytes()

    middle = drawn(b"abcdefgh", 90)
    parts = [drawn(b"xy", 6) + middle + drawn(b"xy", 6) for _ in range(150)]
    seen, expected = set(), []
    for part in parts:
        windows = [part[i:i + 100] for i in range(3)]
        expected.append([w in seen for w in windows])
        seen.update(windows)
    assert [m.tolist() for m in bwt_dedup.repeated(parts, np.zeros(150, np.int64))] == expected


def test_quality_learns_and_holds_out(spark):
    rows = [(i, ("BUY!!! NOW!!! " if i % 4 == 0 else "plain words of a text ") * (1 + i % 9), 10) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    labels = docs.selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS quality")
    out = quality.classify(docs, quality.train(docs, labels, sample=300)).join(labels, "doc_id")
    held = out.where(quality.held_out(F.col("doc_id")))
    assert held.count() == sum(zlib.crc32(str(i).encode()) % 3 == 1 for i in range(600))
    assert held.where("predicted = quality").count() >= 0.98 * held.count()


def test_held_out_labels_and_row_order_do_not_change_the_fit(spark):
    rows = [(i, ("BUY!!! NOW!!! " if i % 4 == 0 else "plain words of a text ") * (1 + i % 9), 10) for i in range(240)]
    rows += [(i, "another text of the same number", 3) for i in range(0, 240, 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    labels = docs.select("doc_id").distinct().selectExpr("doc_id", "CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END AS quality")
    first = quality.train(docs.repartition(3), labels, sample=200)
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    second = quality.train(docs.orderBy(F.desc("text")).repartition(7), flipped, sample=200)
    assert first.bias == second.bias and (first.weights == second.weights).all() and (first.factors == second.factors).all()


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none"])
def test_components(spark, kind):
    from pagequarry.llm.components import components
    rng = np.random.default_rng(7)
    order = rng.permutation(60).tolist()
    links = {"chain": list(zip(order, order[1:])), "star": [(50, i) for i in range(50)],  # noqa: B905
             "random": [(int(a), int(b)) for a, b in rng.integers(0, 90, (60, 2))], "none": [(3, 3)]}[kind]
    root = {n: n for link in links for n in link if link[0] != link[1]}
    for _ in root:
        for a, b in links:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == root


def test_machine_identity():
    rng = np.random.default_rng(1)
    machine = quality.Machine(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    index, value = np.arange(10, 16), rng.normal(size=6)
    pairs = sum(machine.factors[index[a]] @ machine.factors[index[b]] * value[a] * value[b] for a, b in combinations(range(6), 2))
    assert machine.margins(index, value, np.array([0]))[0] == pytest.approx(0.3 + machine.weights[index] @ value + pairs)
