import re

from tracelore.llm import host_rules as hr


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), sum(x in lines[:i] for i, x in enumerate(lines)), len(hit)


def test_measures_against_brute_force():
    for t in (None, "", " \n ", "a", "a b c a b c", "a b c d a b c", "é é é é é", "x\nx\n\n x\nx", "#a *b c\x85d", "a b a b a b q", "one two\none two\r\none two\r\n"):
        assert hr.measured(t) == brute(t), t


def test_prior_of_moments():
    assert hr.fit_prior(0, 0, 0, 0, 0).strength == 2
    assert hr.fit_prior(1, 50, 5, 0.5, 0.02).strength == 2
    even = [(100, 10)] * 20
    sums = lambda hosts: (len(hosts), sum(n for n, _ in hosts), sum(k for _, k in hosts), sum(k * k / n for n, k in hosts), sum(1 / n for n, _ in hosts))
    assert hr.fit_prior(*sums(even)).strength == 1e6
    wild = [(100, 0)] * 10 + [(100, 100)] * 10
    assert hr.fit_prior(*sums(wild)).strength < 5


def test_host_verdicts_join_back(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "bad", "short") for i in range(60)] + [(100, "bad", good)] + [(200 + i, f"host{i % 9}", good) for i in range(180)] + [(900, "tiny", "short"), (901, None, good), (902, None, None), (903, "tiny", "")]
    docs = spark.createDataFrame([(*r, True) for r in rows], "doc_id long, source string, text string, kept boolean")
    out = {r["doc_id"]: r for r in hr.judge(docs, keep=["doc_id", "kept"]).collect()}
    assert len(out) == len(rows)
    assert out[100]["host_rejected"] and not out[100]["kept"] and not out[100]["base_failed"]
    assert all(out[200 + i]["kept"] for i in range(180))
    assert out[901]["kept"] and not out[902]["kept"] and out[902]["n_words"] == 0 and not out[901]["host_rejected"]
    assert not out[900]["kept"]
    assert hr.judge(docs.limit(0), keep=["doc_id"]).count() == 0


def test_watched_hosts_lose_what_breaks_their_rule(spark):
    """A host whose documents repeat lines more than those of others: those of it go, the same at other hosts stay."""
    good = "\n".join(" ".join(f"word{i}x{j}" for i in range(20)) for j in range(6))
    dup = good + "\n" + "\n".join([good.split("\n")[0]] * 2)
    rows = [(h * 1000 + i, f"host{h}", dup if i < (12 if h == 7 else 1) else good) for h in range(30) for i in range(60)] + [(99000, None, dup)]
    docs = spark.createDataFrame([(*r, 5, 6, 7) for r in rows], "doc_id long, source string, text string, __host int, Kept int, Weight int")
    out = hr.judge(docs).collect()
    assert len(out) == len(rows) and {r["Weight"] for r in out} == {7} and {r["__host"] for r in out} == {5}
    gone = {r["doc_id"] for r in out if not r["kept"]}
    assert gone == {7000 + i for i in range(12)} and all(r["host_watched"] == (r["doc_id"] in gone) for r in out)
    even = spark.createDataFrame([(h * 1000 + i, f"host{h}", dup if i < 3 else good) for h in range(30) for i in range(60)], "doc_id long, source string, text string")
    assert hr.judge(even, keep=["doc_id"]).where("not kept").count() == 0


def test_many_hosts_beside_a_hot_one(spark):
    good = " ".join(f"word{i}" for i in range(60))
    docs = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"h{i}", good if i % 5 else "short") for i in range(6000)], "doc_id long, source string, text string")
    out = hr.judge(docs, keep=["doc_id"])
    assert out.count() == 6000 and out.where("host_rate is null").count() == 0
    assert {r["doc_id"] for r in out.where("not base_failed and not kept").collect()} == set()


def test_method_decides_rows_of_the_tables(spark):
    from tracelore.llm.queries import op4_host_rules

    out = op4_host_rules(spark, "/root/testdata/sf0.01")
    assert out.where("host_watched and not base_failed and not kept").count() > 0
