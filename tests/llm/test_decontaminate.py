import random
import time

import numpy as np

from tracelore.llm import decontaminate as dc


def tokens(s):
    return np.array([hash(w) & (1 << 62) - 1 for w in s.split()], np.uint64)


def brute_tiles(p, t, least):
    """Greedy string tiling without hashes: always the longest unmarked common run, first in pattern and then in text."""
    pm, tm, out = [False] * len(p), [False] * len(t), []
    while True:
        best = None
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not pm[i + n] and not tm[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[0]):
                    best = (n, i, j)
        if best is None:
            return out
        n, i, j = best
        out.append((i, j, n))
        for k in range(n):
            pm[i + k] = tm[j + k] = True


def test_rolling_equals_for_equal_runs():
    r = np.random.default_rng(1)
    a = r.integers(0, 1 << 60, 50, np.uint64)
    for size in (1, 2, 3, 5, 8, 13, 50):
        h = dc.rolling(a, size)
        assert len(h) == 51 - size
        assert dc.rolling(a[7 : 7 + size], size)[0:1].tolist() == h[7:8].tolist()[: len(a[7 : 7 + size]) // size]
    assert len(dc.rolling(a, 51)) == 0


def test_tiles_cover_as_the_plain_method_does():
    r = random.Random(5)
    for _ in range(150):
        p = np.array([r.randrange(6) for _ in range(r.randint(1, 25))], np.uint64)
        t = np.array([r.randrange(6) for _ in range(r.randint(0, 40))], np.uint64)
        got, want = dc.tiles(p, t, 3), brute_tiles(p.tolist(), t.tolist(), 3)
        assert got == want
        for i, j, n in got:
            assert p[i : i + n].tolist() == t[j : j + n].tolist()
        for side in (0, 1):
            places = [g[side] + k for g in got for k in range(g[2])]
            assert len(places) == len(set(places))


def test_reordered_passage_is_covered():
    item = "one two three four five six seven eight nine ten eleven twelve"
    text = "x seven eight nine ten eleven twelve y one two three four five six z"
    assert sum(n for _, _, n in dc.tiles(tokens(item), tokens(text), 3)) == 12


ITEMS = [(1, "the quick brown fox jumps over the lazy dog near the old stone bridge"), (2, "short one"), (3, None), (4, ""), (5, "never seen anywhere in any of these many texts at all")]
DOCS = [(1, "a Quick start THE QUICK brown fox jumps over the lazy dog near the old stone bridge indeed"), (2, "near the old stone bridge was seen the quick brown fox jumps over the lazy dog"), (3, "the quick brown fox jumps away"), (4, None), (5, ""), (6, "it is a short one"), (None, ITEMS[0][1]), (7, "filler words " * 20000 + ITEMS[0][1]), (7, "filler words " * 20000 + ITEMS[0][1])]


def frames(spark):
    return spark.createDataFrame([(*d, "x") for d in DOCS], "doc_id long, text string, item_id string"), spark.createDataFrame(ITEMS, "item_id long, text string")


def test_pairs(spark):
    docs, items = frames(spark)
    got = sorted(((r["doc_id"] or 0, r["item_id"], r["covered"]) for r in dc.contaminated(docs, items).collect()))
    assert got == [(0, 1, 14), (1, 1, 14), (2, 1, 14), (6, 2, 2), (7, 1, 14), (7, 1, 14)]
    low = {r["doc_id"] for r in dc.overlaps(docs, items).collect()}
    assert 3 in low
    assert dc.overlaps(docs, items.limit(0)).count() == dc.overlaps(docs.limit(0), items).count() == 0


def test_full_filter_finds_the_same(spark):
    docs, items = frames(spark)
    key = lambda df: sorted((r["doc_id"] or 0, r["item_id"], r["covered"]) for r in df.collect())
    assert key(dc.overlaps(docs, items, bits=6)) == key(dc.overlaps(docs, items))


def test_decontaminated_keeps_the_rest_with_all_columns(spark):
    docs, items = frames(spark)
    docs = docs.selectExpr("*", "1 as hits", "2 as uid", "3 as T", "4 as Weight", "5 as key")
    for bits in (6, 24):
        kept = dc.decontaminated(docs, items, bits=bits)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]


def test_repetitive_texts_take_no_time():
    start = time.monotonic()
    one, two = np.full(1000, 7, np.uint64), np.tile(np.array([3, 5], np.uint64), 500)
    assert dc.tiles(one, np.full(200_000, 7, np.uint64), 3) == [(0, 0, 1000)]
    assert dc.tiles(two, np.tile(np.array([3, 5], np.uint64), 100_000), 3) == [(0, 0, 1000)]
    r = np.random.default_rng(0)
    spotted = lambda n: np.stack([np.full(n, 1), np.full(n, 2), np.full(n, 3), r.integers(10, 1 << 60, n)], 1).ravel().astype(np.uint64)
    got = dc.tiles(spotted(250), spotted(10_000), 3)
    assert len(got) == 250 and {g[2] for g in got} == {3}
    assert time.monotonic() - start < 20


def test_seeds_lose_no_pair_of_the_tables(spark):
    """Every document against every item by tiling alone, without seeds: no pair over the coverage is missing from the join."""
    d = "/root/testdata/sf0.001"
    docs, items = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet")
    held = [(r["item_id"], dc.word_hashes(dc.words(r["text"]))) for r in items.collect()]
    want = set()
    for r in docs.collect():
        t = dc.word_hashes(dc.words(r["text"]))
        for i, p in held:
            if np.isin(p, t).mean() >= 0.6 and sum(g[2] for g in dc.tiles(p, t, 3)) >= 0.6 * len(p):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, items).collect()}
    assert want and got == want
