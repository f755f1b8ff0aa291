import random
import time

import pytest
from pyspark.sql import functions as F

from tracelore.llm import toxicity as tx
from tracelore.llm.common import fold_of
from tracelore.llm.queries import op1_toxicity


def test_fold_lookalikes_digits_and_invisible():
    assert tx.fold("1DФ0T".replace("Ф", "i")) == "idiot"
    assert tx.fold("mоr​on") == "moron"
    assert tx.fold("Ｓtup1d") == "stupid"
    assert tx.fold("LO$ER!! id!ot, scum!") == "loser!! idiot, scum!"
    assert tx.fold(None) == ""


def test_matches_words_beginnings_and_exceptions():
    match = tx.Lexicon({"idiot": 2.0, "lowei*": 1.5, "trash": 1.0}, exceptions=("trash can",)).matcher()
    assert match("an IDI0T, loweiter") == (3.5, 2, ["idiot", "lowei*"])
    assert match("idiotic blowei") == (0.0, 0, [])
    assert match("a trash can; trash") == (1.0, 1, ["trash"])
    assert match("idiot idiot")[1] == 2
    assert match(None) == match("") == (0.0, 0, [])


def test_nested_terms_count_once():
    match = tx.Lexicon({"scum": 2.0, "scu*": 1.0, "scumbag": 3.0}).matcher()
    assert match("scumbag") == (3.0, 1, ["scumbag"])


def plain(lexicon, text):
    """Every place of every term, looked for without an automaton; of those at one place the heaviest, none inside an exception phrase."""
    folded = tx.fold(text)
    places = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i) and not (i and folded[i - 1].isalpha())]
    whole = lambda i, t: i + len(t) == len(folded) or not folded[i + len(t)].isalpha()
    shields = [(i, i + len(p)) for p in map(tx.fold, lexicon.exceptions) for i in places(p) if whole(i, p)]
    best = {}
    for term, weight in lexicon.terms.items():
        t = tx.fold(term.rstrip("*"))
        for i in places(t):
            if (term.endswith("*") or whole(i, t)) and not any(a <= i and i + len(t) <= b for a, b in shields):
                best[i] = max(best.get(i, (-1.0, "")), (weight, term))
    return sum(w for w, _ in best.values()), len(best), sorted({t for _, t in best.values()})


def test_matches_against_a_plain_scan():
    r = random.Random(2)
    lexicon = tx.Lexicon({"idiot": 2.0, "idi*": 1.0, "trash": 1.5, "scum": 2.5, "scu*": 0.5, "bag": 1.0}, exceptions=("trash can", "can trash can idiot", "scum bag"))
    match = lexicon.matcher()
    pieces = ["idiot", "1d10t", "idiotic", "trash", "can", "scum", "scumm", "bag", " ", " ", " ", ", ", "x", "é", "SCUM", "tra​sh"]
    for _ in range(3000):
        t = "".join(r.choice(pieces) for _ in range(r.randint(0, 14)))
        got, want = match(t), plain(lexicon, t)
        assert got[0] == pytest.approx(want[0]) and got[1:] == want[1:], t


def test_many_exceptions_and_long_words_take_linear_time():
    match = tx.Lexicon({"trash": 1.0}, exceptions=("trash can",)).matcher()
    start = time.monotonic()
    assert match("trash can, " * 100_000 + "trash")[1] == 1
    assert match("a" * 1_000_000)[1] == 0
    assert len(tx.candidate_terms("a" * 1_000_000)) < 100
    assert time.monotonic() - start < 10


def test_threshold():
    same = {0: 1.0, 1: 1.0}
    assert tx.best_threshold([(0.0, 0), (1.0, 1), (0.6, 1)], same) == (1.0, pytest.approx(0.3))
    assert tx.best_threshold([(0.2, 0), (1.0, 1)], same) == (1.0, pytest.approx(0.6))
    assert tx.best_threshold([(0.0, 0)], same)[1] > 0
    # a clean text that stands for many moves the cut above it
    mixed = [(0.5, 0), (0.4, 1), (1.0, 1)]
    assert tx.best_threshold(mixed, same)[1] < 0.4 < 0.5 < tx.best_threshold(mixed, {0: 20.0, 1: 1.0})[1]


def test_learns_stems_and_scores(spark):
    bad = [(i, f"wort grublehan {i} grublesta" if i % 2 else f"you are vile{i} grublech", "x") for i in range(40)]
    good = [(100 + i, f"wort and more {i} harmless words", "x") for i in range(200)]
    docs = spark.createDataFrame([*bad, *good, (900, None, "x"), (901, "", "x")], "doc_id long, text string, toxic_score string")
    labels = spark.createDataFrame([*((i, 1) for i, _, _ in bad), *((i, 0) for i, _, _ in good), (None, 1), (5, None)], "doc_id long, toxic int")
    lexicon = tx.learn(docs, labels)
    assert "gruble*" in lexicon.terms and not any(t.startswith("wort") for t in lexicon.terms if t not in tx.SEED_TERMS)
    rows = {r["doc_id"]: r["toxic_score"] for r in tx.score(docs, lexicon).collect()}
    assert all(rows[i] >= 0.5 for i, _, _ in bad) and all(rows[i] < 0.5 for i, _, _ in good)
    assert rows[900] == rows[901] == 0.0
    assert tx.score(docs.limit(0), lexicon).count() == 0
    assert tx.learn(docs, labels.limit(0)).terms.keys() == set(tx.SEED_TERMS)


def test_sharp_terms_behind_many_frequent_ones(spark):
    r = random.Random(5)
    common = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)) for _ in range(4000))
    docs = spark.createDataFrame([(i, common + " vrokzaph" * (i < 20)) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 40)) for i in range(120)], "doc_id long, toxic int")
    assert "vrokzaph" in tx.learn(docs, labels).terms


def test_beginnings_explained_by_sharper_terms_go():
    counts = {"los*": (80, 60), "loser": (56, 0), "lost*": (20, 0), "alone*": (80, 60)}
    good = tx.chosen(counts, 100, 8000, 4.0, 25.0)
    assert "los*" not in good and {"loser", "lost*", "alone*"} <= set(good)
    assert "weak" not in tx.chosen({"weak": (46, 45)}, 1735, 7965, 4.0, 25.0)


def test_long_text_and_repeats(spark):
    docs = spark.createDataFrame([(1, "idiot " + "calm words " * 30000), (1, "idiot " + "calm words " * 30000)], "doc_id long, text string")
    out = tx.score(docs, tx.Lexicon({"idiot": 6.0}, 0.5)).collect()
    assert len(out) == 2 and out[0]["toxic_score"] == out[1]["toxic_score"] > 0


def test_clean_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "idiot", 7, 1, 2, 3), (2, "calm", 8, 1, 2, 3), (3, None, 9, 1, 2, 3)], "doc_id long, text string, weight int, __value int, Matched int, __k int")
    lexicon = tx.Lexicon({"idiot": 6.0}, 0.5)
    kept = tx.clean(docs, lexicon)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect())) == [(2, "calm", 8, 1, 2, 3), (3, None, 9, 1, 2, 3)]
    assert tx.score(docs.withColumnRenamed("weight", "Weight"), lexicon).where("toxic_score > 0").count() == 1


def test_held_out_recall_and_precision(spark):
    d = "/root/testdata/sf0.1"
    out = op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(fold_of("doc_id") == 0)
    assert out.where(~F.col("held_out")).count() == 0
    n = {(r["predicted"], r["toxic"]): r["count"] for r in out.groupBy("predicted", "toxic").count().collect()}
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[0, 1])
    assert n[1, 1] >= 0.95 * (n[1, 1] + n.get((1, 0), 0))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    out = op1_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(fold_of("doc_id") == 0)
    assert out.where(~F.col("held_out")).count() == 0
    right = out.where(F.col("predicted") == F.col("toxic")).count()
    assert right >= 0.95 * out.count()
