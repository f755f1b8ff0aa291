import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelore.llm import lm


def brute(rows):
    """The model in plain dictionaries: a walk over states with failure arcs, token by token; null texts are empty."""
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    seq = [(k, t, [*re.findall(r"[^\x20\x09-\x0D]+", (x or "").translate(lower)), "</s>"]) for k, t, x in rows]
    grams, history = Counter(), Counter()
    for _, t, s in seq:
        s = ["<s>", *s]
        for i in range(1, len(s) if t else 0):
            grams[(s[i],)] += 1
            for n in (2, 3):
                if i - n + 1 >= 0:
                    grams[tuple(s[i - n + 1 : i + 1])] += 1
                    history[tuple(s[i - n + 1 : i])] += 1
    n, v = sum(c for g, c in grams.items() if len(g) == 1), sum(len(g) == 1 for g in grams)
    kappa = {}
    for m in (1, 2):
        novel = sum(c == 1 for g, c in grams.items() if len(g) == m + 1)
        expected = lambda k: sum(c * k / (c - 1 + k) for h, c in history.items() if len(h) == m)  # noqa: B023, E731
        kappa[m] = next((k for k in lm.GRID if expected(k) >= novel), lm.GRID[-1])

    def weight(state, word):  # of the arc, which exists or is the root's
        if not state:
            return (grams[(word,)] + 0.5) / (n + 0.5 * (v + 1))
        k = kappa[len(state)]
        return (grams[(*state, word)] + k * weight(state[1:], word)) / (history[state] + k)

    out = []
    for k, t, s in seq:
        base = score = 0.0
        state = ("<s>",) if history[("<s>",)] else ()
        for w in s:
            base += math.log10(weight((), w))
            before = state
            while state and not grams[(*state, w)]:
                score += math.log10(kappa[len(state)] / (history[state] + kappa[len(state)]))
                state = state[1:]
            score += math.log10(weight(state, w))
            state = (*before, w)[-2:]
            while state and not history[state]:
                state = state[1:]
        out.append((k, t, len(s), sum(grams[(w,)] > 0 for w in s), n, base, score))
    return out


@pytest.mark.parametrize("size", [300, 4 << 20])
def test_against_brute_force(spark, size):
    r = random.Random(4)
    words = [f"W{i}" for i in range(40)] + ["the"] * 20
    rows = [(i, i % 5 != 1, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(120)] + [(500, True, None), (501, False, ""), (502, True, "the " * 20000), (503, False, "Ünseen É é"), (7, True, "the W1"), (7, True, "the W1"), (None, False, "the W1")]
    docs = spark.createDataFrame([(*x, 9.0) for x in rows], "doc_id long, train boolean, text string, score double").repartition(3)
    got = lm.score(docs, train=F.col("train"), block_bytes=size, range_bytes=size).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[2])
    got, want = sorted((tuple(x) for x in got), key=key), sorted(brute(rows), key=key)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in got], [x[5:] for x in want], rtol=0, atol=1e-6)


def test_states_sum_to_one():
    m = lm.BackoffAutomaton(10, 3, (4.0, 2.0))
    one, two, three = [5, 3, 2], [2, 1, 0], [1, 0, 0]  # counts of three words: alone, after a token of count 3, after two of count 1
    for seen in ([0, 0], [3, 0], [3, 1]):
        total = 0.0
        for w in range(4):
            grams = [np.array([(*x, 0)[w]]) for x in (one, two, three)]
            total += 10 ** m.run(grams, [np.array([h]) for h in seen])[0]
        assert total == pytest.approx(1.0)


def test_failure_weight_follows_novelty():
    assert lm.chosen([0.0] * len(lm.GRID), 0) == lm.GRID[0]
    counts = np.array([100] * 10)
    sure, open_ = (lm.chosen([lm.failing(counts, k) for k in lm.GRID], n) for n in (5, 800))
    assert sure < 1 < 100 < open_


def test_empty_and_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert lm.score(docs.limit(0), train=F.lit(True)).count() == 0
    out = sorted(lm.score(docs, train=F.lit(None).cast("boolean")).collect())
    assert [x["n_known"] for x in out] == [0, 0] and out[0]["score"] == pytest.approx(0.0)


def test_held_out_text_is_likelier_than_by_single_words(spark):
    from tracelore.llm.queries import op10_lm_scoring

    out = op10_lm_scoring(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert (out[0] - out[1]) / out[2] > 0.5  # log10 a token
