"""Prefix trie, periodic runs and license scans against brute force, on ordinary and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pagequarry.llm import license_scan, period_runs, prefix_trie

BLANKS = "[\x20\x09-\x0D]+"


def words_of(text):
    return [w for w in re.split(BLANKS, text or "") if w]


# --- trie -----------------------------------------------------------------------------------------------

def brute_trie(rows, rebuild=True):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - c % 20, [])[:h] + turns[h:] if rebuild else turns
    nodes = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids, leaves, saved = (defaultdict(int) for _ in range(3))
    for path in nodes:
        if path:
            kids[path[:-1]] += 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += (len(members) - 1) * len(words_of(path[-1][1])) if path else 0
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(c for c in members if len(built[c]) == len(path)))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), kids.get(path, 0),
                    leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


TURNS = "conv_id bigint, turn bigint, role string, text string, depth string, seq int, `key` string"


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 90):
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "a b", "hello", "two  words\n"]))
                 for t in range(rng.choice([1, 2, 3, 5, 9]))]
    copied = [(500 + c, t, "user", f"copy {t}") for c in range(60) for t in range(4)]
    nested = [(700 + c, t, "user", f"nest {t}") for c in range(12) for t in range(c + 1)]
    long = [(900 + 20 * c, t, "user", f"{t % 7} w" if t < 380 + c else "end") for c in range(3) for t in range(400)]
    odd = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", "x"), (7, 0, "user", "x"), (7, 0, "user", "x"), (-5, 0, "user", "n")]
    return rows + copied + nested + (long if seed == 1 else []) + odd


@pytest.mark.parametrize(("seed", "parts"), [(1, 1), (2, 60), (3, 7)])
def test_trie(spark, monkeypatch, seed, parts):
    monkeypatch.setattr(prefix_trie, "PARTITION_BYTES", 20_000 if parts < 60 else 300)
    rows = [r for r in conversations(seed) if r[0] is None or r[0] >= 0]
    frame = spark.createDataFrame([(*r, "d", 1, "k") for r in rows], TURNS).repartition(parts)
    rebuild = seed != 3
    got = prefix_trie.prefix_trie(frame, prefix_trie.FAMILY if rebuild else None).select(*prefix_trie.COLUMNS).collect()
    assert sorted(map(tuple, got), key=repr) == brute_trie(rows, rebuild)


def test_trie_of_one_partition_and_of_none(spark):
    frame = spark.createDataFrame([(*r, "d", 1, "k") for r in conversations(2)], TURNS)
    assert prefix_trie.prefix_trie(frame.where("conv_id < -100")).count() == 0
    assert prefix_trie.prefix_trie(frame.where("conv_id IS NULL")).count() == 0
    one = prefix_trie.prefix_trie(frame.where("conv_id = 500"), None).orderBy("depth").collect()
    assert [(r.depth, r.n_children, r.n_leaves, r.saved_tokens) for r in one] == [(0, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0), (4, 0, 1, 0)]


def test_ids_of_equal_sequences_in_chunks(monkeypatch):
    monkeypatch.setattr(prefix_trie, "ROWS", 8)
    monkeypatch.setattr(prefix_trie, "CHUNK_BYTES", 100)
    rows = [(b"a", i, b"A") for i in range(50)] + [(b"b", 3, b"B")] + [(b"c", i, b"C") for i in range(9)]
    schema = pa.schema([("key", pa.binary()), ("conv_id", pa.int64()), ("seq", pa.binary())])
    parts = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[a:b]], schema=schema) for a, b in ((0, 20), (20, 60))]
    chunks = [c for part in parts for c in prefix_trie._id_chunks(iter([part]))]   # two tasks
    assert sum(len(c) for c in chunks) > 10
    got = pa.Table.from_batches(prefix_trie._hashed_ends(iter(chunks))).to_pylist()
    sha = lambda n: hashlib.sha256(",".join(map(str, n)).encode()).hexdigest()
    assert [tuple(r.values()) for r in got] == [(b"A", 50, 0, sha(range(50))), (b"B", 1, 3, sha([3])), (b"C", 9, 0, sha(range(9)))]


@pytest.mark.parametrize("contract", [False, True])
def test_forest_of_random_sequences(contract):
    """The union-find alone: partitions of any size give the same nodes once their spines are merged."""
    rng = random.Random(5)
    for _ in range(60):
        seqs = sorted({b"".join(bytes([rng.randrange(3)]) * 16 + (1 + rng.randrange(1)).to_bytes(4, "big") for _ in range(rng.randrange(6)))
                       for _ in range(rng.randrange(1, 25))})
        hangs = [{len(s) // 20: (1, i, 0, 0, 0, f"e{i}")} for i, s in enumerate(seqs)]
        whole = {(n[0], n[1]): (n[:7], parent) for n, parent, _ in prefix_trie.Forest(seqs, hangs, contract=False).nodes()}
        prefixes = {s[:d * 20] for s in seqs for d in range(len(s) // 20 + 1)}
        assert len(whole) == len(prefixes)
        if not contract:
            continue
        cut = rng.randrange(len(seqs) + 1)
        found, spines, hung, open_parents = {}, [], [], []
        for part in (seqs[:cut], seqs[cut:]):
            at = seqs.index(part[0]) if part else 0
            forest = prefix_trie.Forest(part, hangs[at:at + len(part)], contract=True)
            for node, parent, place in forest.nodes():
                if place is None:
                    found[node[0], node[1]] = (node[:7], parent)
                else:
                    open_parents.append((node, len(spines) + place[0], place[1]))
            for spine, seq in enumerate([part[0], part[-1]][:len(part)] if part else []):
                spines.append(seq)
                hung.append({d: t.state() for d, t in forest.spines[spine].items()})
        above = {}
        for node, parent, _ in prefix_trie.Forest(spines, hung, contract=False).nodes():
            found[node[0], node[1]] = (node[:7], parent)
            above.update({(i, node[1]): node[0] for i in range(node[7], node[8] + 1)})
        for node, spine, depth in open_parents:
            found[node[0], node[1]] = (node[:7], above[spine, depth])
        assert found == whole


# --- runs -------------------------------------------------------------------------------------------------

def brute_runs(x, least=24, power=3):
    found = {}
    for q in range(1, len(x) // power + 1):
        s = 0
        while s < len(x) - q:
            e = s
            while e < len(x) - q and x[e] == x[e + q]:
                e += 1
            if e > s and e + q - s >= max(least, power * q):
                found.setdefault((s, e + q - s), q)
            s = e + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_of_random_words(monkeypatch):
    monkeypatch.setattr(period_runs, "BATCH_WORDS", 300)
    rng, n_runs = random.Random(1), 0
    for _ in range(150):
        docs = []
        for _ in range(rng.randint(1, 6)):
            x = []
            while len(x) < rng.randint(0, 200):
                unit = [rng.randrange(rng.choice([1, 2, 3, 6, 50])) for _ in range(rng.randint(1, 30))]
                x += (unit * rng.randint(1, 9))[rng.randint(0, 2):]
            docs.append(np.array(x, np.int64))
        least, power = rng.choice([(24, 3), (6, 3), (4, 2)])
        got = period_runs.runs_of_all(docs, least, power)
        n_runs += sum(map(len, got))
        assert got == [brute_runs(d.tolist(), least, power) for d in docs]
    assert n_runs > 500


def brute_digest(doc_id, text):
    w = words_of(text)
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n and doc_id is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


DOCS = "doc_id bigint, text string, n_words string, runs int, best string, licenses string, `key` string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "x " * 3000, "\x0b".join(["la", "lé", "li"] * 20), "no break   " * 30, "A a " * 12, "a\x00b " * 24]
    texts += [" ".join(rng.choice(["ab", "cd", "é", "E f"]) for _ in range(rng.randint(1, 150))) for _ in range(150)]
    texts += [" ".join(f"w{i % 700}" for i in range(30_000)), "word " * 23, "word " * 24, "MIT  License", "see the mit-license and CC BY 4.0 cc-by"]
    rows = [(i, t, "n", 1, "b", "l", "k") for i, t in enumerate(texts)] + [(None, "y " * 40, "n", 1, "b", "l", "k")]
    return spark.createDataFrame(rows + [rows[5], rows[5]], DOCS).repartition(3).cache()


def test_runs_of_documents(docs):
    want = sorted((brute_digest(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 100_000), key=repr)
    found = period_runs.periodic_runs(docs, cycles=True)
    assert "best" in found.columns and "key" in found.columns
    long = docs.where("length(text) >= 100000").select("doc_id")
    got = period_runs.digest(found).join(long, "doc_id", "left_anti").collect()
    assert sorted(map(tuple, got), key=repr) == want
    plain = period_runs.periodic_runs(docs).join(long, "doc_id").first()
    assert [tuple(r) for r in plain.runs] == [(0, 30_000, 700)] and plain.collapsed == " ".join(f"w{i}" for i in range(700))
    assert period_runs.digest(period_runs.periodic_runs(docs.where("doc_id < 0"))).count() == 0


# --- licenses ------------------------------------------------------------------------------------------------

def license_words(text):
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_base(text):
    w = license_words(text)
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in found]
    return len(w), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_fuzzy(text):
    """Labels of all notices that some stretch of words matches within the bound."""
    w, labels = license_words(text), set()
    for notice, label in license_scan.NOTICES:
        k, m = len(notice) // license_scan.CHARS_PER_ERROR, len(notice)
        stretches = (" ".join(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1))
        if any(abs(len(s) - m) <= k and distance(s, notice) <= k for s in stretches):
            labels.add(label)
    return labels


def test_licenses(docs, spark):
    rng = random.Random(6)
    made = []
    for i in range(60):
        notice = list(rng.choice(license_scan.NOTICES)[0])
        for _ in range(rng.randrange(8)):
            notice[rng.randrange(len(notice))] = rng.choice(["", "x", " ", "é", "ab"])
        made.append((1000 + i, "some é words. " + "".join(notice).title() + rng.choice([" more", "", ", MIT-License\nGNU general public license license"])))
    frame = docs.select("doc_id", "text").unionByName(spark.createDataFrame(made, "doc_id bigint, text string"))
    texts = {r.doc_id: r.text for r in frame.collect()}
    found = license_scan.digest(license_scan.scan_licenses(frame)).collect()
    assert len(found) == frame.count() and max(r.n_base for r in found) > 1
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
        assert 0 <= r.score <= 1 and (r.score == 1) >= bool(r.n_base) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        if r.doc_id is not None and r.doc_id >= 1000:
            assert set(filter(None, r.labels.split(","))) == brute_fuzzy(texts[r.doc_id]) | set(filter(None, r.base_labels.split(","))), texts[r.doc_id]
    assert license_scan.scan_licenses(docs.where("doc_id < 0")).count() == 0
    assert "key" in license_scan.scan_licenses(docs).columns


def test_license_spans():
    machine = license_scan.scanner(license_scan.NOTICES, license_scan.CHARS_PER_ERROR)
    text = "The GNU Genral Public Licence (v3), é; Mit licence mit license " * 400
    n, hits = license_scan.scan_text(text, machine)
    assert n == 400 * 11 and sum(h["label"] == "gpl" for h in hits) == 400
    near, exact = ([h for h in hits if h["label"] == "mit" and h["exact"] == e] for e in (False, True))
    assert [(h["start"], h["end"], h["errors"]) for h in near] == [(11 * i + 7, 11 * i + 9, 1) for i in range(400)]
    assert [(h["start"], h["end"]) for h in exact] == [(11 * i + 9, 11 * i + 11) for i in range(400)]


@pytest.mark.parametrize("notice", ["mit license", "gnu general public license"])
def test_seeds_cover_every_match(notice):
    rng = random.Random(8)
    k = len(notice) // license_scan.CHARS_PER_ERROR
    for _ in range(300):
        text = list(notice)
        for _ in range(k):
            text[rng.randrange(len(text))] = rng.choice(["", "q", "qq"])
        assert any(seed in "".join(text) for _, seed in license_scan.pieces(notice, k))
