import random
import re

import numpy as np
import pytest

from tracelore.llm import near_dup as nd
from tracelore.llm.common import Scratch
from tracelore.llm.components import components


def brute(rows, n, pct):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = {}
    for k, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets[k] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    top = {k: k for k in sets}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and both and 100 * both >= pct * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                top[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def corpus(seed, families=6, members=25):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.randint(30, 160))]
        for _ in range(members):
            copy = list(base)
            for _ in range(r.choice((0, 0, 1, 2, 3, 5, 8))):
                copy[r.randrange(len(copy))] = r.choice(words)
            if r.random() < 0.3:
                base = copy  # versions build on one another
            rows.append((k, r.choice((" ", "\n", "\t ")).join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize(("n", "pct", "seed"), [(3, 85, 1), (5, 80, 2), (3, 85, 3)])
def test_classes_against_brute_force(spark, n, pct, seed):
    rows = [*corpus(seed), (1000, None), (1001, ""), (1002, " \n"), (1003, "Solo"), (1004, "solo"), (1005, "two words"), (1006, "TWO  words"), (1007, "Été two"), (1008, "été two"), (1009, "x " * 30000), (1010, "x " * 29000)]
    random.Random(seed).shuffle(rows)
    out = nd.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, pct=pct).collect()
    want = brute(rows, n, pct)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def test_differences_lose_no_link(spark):
    """A large family whose members mostly miss the threshold to their hub."""
    r = random.Random(8)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for k in range(150):
        copy = list(base)
        for _ in range(r.randint(2, 9)):
            copy[r.randrange(120)] = f"e{r.randrange(40)}"
        rows.append((k, " ".join(copy)))
        if k % 10 == 0:
            copy[0] = "again"
            rows.append((500 + k, " ".join(copy)))
    out = nd.classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, pct=85).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in out} == brute(rows, 3, 85)


def test_min_and_max_estimate_similarity():
    r = np.random.default_rng(0)
    every = r.integers(0, 1 << 63, 3000, np.uint64)
    a, b = nd.permutations(400)
    x, y = nd.min_max_signature(np.sort(every[:2000]), a, b), nd.min_max_signature(np.sort(every[1000:]), a, b)
    assert abs(np.mean(x == y) - 1 / 3) < 0.05


def test_bands_miss_little():
    for pct in (70, 80, 85, 90):
        bands, rows = nd.plan(pct)
        assert (1 - (pct / 100) ** rows) ** bands <= 1e-7


def test_deduplicate_keeps_columns_and_one_of_each(spark):
    rows = [(1, "a b c d e f", "k"), (2, "a b c d e f", "k"), (3, "z", None), (4, None, "k"), (5, None, "k"), (None, "a b c d e f", "k"), (None, "only null", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = nd.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4", "5", "None", "None"]
    assert nd.deduplicate(docs.limit(0)).count() == 0


def test_components(spark, monkeypatch):
    import tracelore.llm.components as c

    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 1), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = root(a), root(b)
            top[max(x, y)] = min(x, y)
    want = {x: root(x) for x in top}
    assert {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()} == want
    monkeypatch.setattr(c, "PART", 60)  # several partitions: rounds of stars
    assert {r["node"]: r["component"] for r in components(df, Scratch(spark, "t")).collect()} == want
    assert components(df.limit(0), Scratch(spark, "t")).count() == 0
