"""Routing of batches against the one-by-one order, ingest and consolidation against plain loops."""

import random

import pytest

from pagequarry.operators import ingest

BATCH = "db string, ord bigint, filename string, title string, type string, terms array<string>, facts array<string>, fixed string"
KNOWN = "db string, filename string, title string, type string, key_terms array<string>"


def one_by_one(batch, known):
    """What the pages of one database become when each looks at all that came before it."""
    registry = {f: [t, frozenset(title.split()), list(terms)] for _, f, title, t, terms in sorted(known)}
    out = {}
    for _, at, name, title, kind, terms, facts, fixed in sorted(batch, key=lambda r: r[1]):
        tokens, exact, near = frozenset(title.split()), None, None
        for other, (k, topic, held) in registry.items():
            if other == name or k != kind or not topic or not tokens:
                continue
            if topic == tokens:
                exact = exact or other
            elif (topic <= tokens or tokens <= topic) and terms and held and \
                    len(set(terms) & set(held)) / min(len(set(terms)), len(set(held))) >= 0.7:
                near = near or other
        out[at] = target = fixed or exact or near or name
        if fixed:
            continue
        if target in registry:
            registry[target][2] = list(dict.fromkeys(registry[target][2] + facts))[:12]
        else:
            registry[target] = [kind, tokens, list(dict.fromkeys(terms))[:12]]
    return out


def random_batch(rng, words, n, n_known, names):
    title = lambda: " ".join(rng.sample(words, rng.randint(1, 3)))
    terms = lambda: rng.sample("abcdefghijklmnop", rng.randint(0, 5))
    kinds = ["concept", "concept", "entity"]
    known = [("d", f"k{i:02}.md", title(), rng.choice(kinds), rng.sample("abcdefgh", rng.randint(1, 5))) for i in range(n_known)]
    batch = []
    for i in range(n):
        own = terms()
        batch.append(("d", 10 * i, f"n{rng.randrange(names):02}.md" if rng.random() < 0.8 else f"k{rng.randrange(9):02}.md", title(), rng.choice(kinds),
                      own, rng.sample(own, rng.randint(0, len(own))), "summary-x.md" if rng.random() < 0.1 else None))
    return batch, known


@pytest.mark.parametrize("seed", [2])
def test_batch_is_routed_as_one_by_one(spark, seed):
    rng = random.Random(seed)
    batch, known = random_batch(rng, ["zug", "tor", "amt"] if seed == 1 else ["zug", "tor", "amt", "hof", "rad", "ohr", "uhr"], 24, 5, 15)
    # a hot topic: pages alike that all go to a page of a nested topic
    batch += [("d", 1000 + i, f"hot{i}.md", "berg tal", "concept", ["q", "r"], ["q", "r"], None) for i in range(30)]
    known.append(("d", "wide.md", "berg", "concept", ["q", "r", "s"]))
    # a chain in which every page becomes the target of the next
    batch += [("d", 2000 + i, f"chain{i}.md", " ".join(["see", "ufer", "boot", "netz"][:i + 1]), "entity", [f"t{i}", f"t{i + 1}", "u", "v", "w"], ["u"], None)
              for i in range(4)]
    got = ingest.route_batch(spark.createDataFrame(batch, BATCH).repartition(3), spark.createDataFrame(known, KNOWN)).collect()
    assert {r.ord: r.target for r in got} == one_by_one(batch, known) and len(got) == len(batch)


def test_empty_and_first_batches(spark):
    none = spark.createDataFrame([], KNOWN)
    assert ingest.route_batch(spark.createDataFrame([], BATCH), none).count() == 0
    batch = [("d", 1, "a.md", "!!!", "concept", [], [], None), ("d", 2, "b.md", "!!!", None, None, None, None), ("e", 1, "a.md", "zug", "", ["x"], [], None)]
    got = ingest.route_batch(spark.createDataFrame(batch, BATCH), none).collect()
    assert sorted((r.db, r.ord, r.target) for r in got) == [("d", 1, "a.md"), ("d", 2, "b.md"), ("e", 1, "a.md")]
