import random
from collections import defaultdict

from tracelore.llm import packing as pk


def best_fit(lengths, capacity):
    """Plain best-fit decreasing into bins of one capacity."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = min((b for b in bins if capacity - b[0] >= n), key=lambda b: capacity - b[0], default=None)
        if fit is None:
            bins.append([n])
        else:
            fit[0] += n
    return len(bins)


def test_histogram_packs_as_single_pieces_do():
    r = random.Random(6)
    for _ in range(30):
        lengths = [min(64, int(r.paretovariate(1)) + r.randint(0, 20)) for _ in range(r.randint(1, 400))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        _, groups = pk.pack(dict(histogram), [64], 0)
        assert sum(n for _, n, _, _ in groups) == best_fit(lengths, 64)
        assert sum(n * used for _, n, used, _ in groups) == sum(lengths)


def test_plan_grows_with_lengths_not_pieces():
    r = random.Random(1)
    histogram = {n: r.randint(1, 9) for n in range(1, 1500)}
    few = pk.best_pack(histogram)[0]
    many = pk.best_pack({n: c * 100_000 for n, c in histogram.items()})[0]
    assert len(many) < 4 * len(few) + 10_000


def test_several_capacities_cost_no_more_than_one():
    r = random.Random(2)
    histogram = {r.randint(1, 4096): r.randint(1, 5) for _ in range(300)}
    cost = lambda groups: sum(n * (c + pk.OVERHEAD) for _, n, _, c in groups)
    assert cost(pk.best_pack(histogram)[1]) <= cost(pk.pack(histogram, [4096])[1])


def test_joint_choice_costs_no_more_than_plain_best_fit_with_any_capacity():
    r = random.Random(8)
    for _ in range(25):
        lengths = [r.choice((3, 5, 9, 14, 17, 30, 33, 60, r.randint(1, 64))) for _ in range(r.randint(1, 120))]
        histogram = defaultdict(int)
        for n in lengths:
            histogram[n] += 1
        plain = []
        for c in (x for x in (16, 32, 64) if x >= max(lengths)):
            bins = []
            for n in sorted(lengths, reverse=True):
                fit = min((b for b in bins if c - b[0] >= n), key=lambda b: c - b[0], default=None)
                if fit is None:
                    bins.append([n])
                else:
                    fit[0] += n
            plain.append(sum(min(x for x in (16, 32, 64) if x >= b[0]) + 4 for b in bins))
        assert sum(n * (c + 4) for _, n, _, c in pk.best_pack(dict(histogram), (16, 32, 64), 4)[1]) <= min(plain)


def test_plan_has_the_size_its_bound_says():
    r = random.Random(4)
    placed, groups = pk.best_pack({n: r.randint(1, 10**9) for n in range(1, 4097)})
    assert len(groups) <= 6 * 4096 and len(placed) <= 72 * 4096


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 5 + 1), 1, 2, 3, 4) for i in range(50)], "doc_id long, text string, K int, piece int, Length int, salt int")
    out = pk.pack_documents(docs)
    assert out.columns == ["doc_id", "piece", "start", "length", "bin_id", "bin_capacity", "bin_offset"] and out.count() == 50


def test_bins_hold_all_pieces_without_overlap(spark):
    r = random.Random(3)
    texts = ["w " * r.choice((1, 3, 3, 3, 7, 40, 64, 65, 130, 200)) for _ in range(300)] + [None, "", " \n"]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)] + [(None, "a b", 5), (7, texts[7], 5)], "doc_id long, text string, length int").repartition(4)
    out = pk.pack_documents(docs, capacities=(16, 32, 64)).collect()
    pieces, bins = defaultdict(list), defaultdict(list)
    for x in out:
        pieces[x["doc_id"]].append(x)
        if x["bin_id"] is None:
            assert x["length"] == 0 and x["bin_offset"] is None
        else:
            bins[x["bin_id"], x["bin_capacity"]].append((x["bin_offset"], x["length"]))
    assert len({b for b, _ in bins}) == len(bins)
    for (_, capacity), held in bins.items():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= capacity and capacity == min(c for c in (16, 32, 64) if c >= at)
    for i, t in enumerate(texts):
        n = len((t or "").split())
        own = sorted(pieces[i], key=lambda x: x["start"])
        assert sum(x["length"] for x in own) == n * (2 if i == 7 else 1)
        if i != 7:
            assert [x["start"] for x in own] == list(range(0, max(n, 1), 64)) and [x["piece"] for x in own] == list(range(len(own)))
    assert len(pieces[None]) == 1
    assert pk.pack_documents(docs.limit(0)).count() == 0
