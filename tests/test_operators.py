import math

import pytest
from pyspark.sql import functions as F

from tracelore.functions import features as ft
from tracelore.operators import actions, evaluation, forest, lineage, model, ranking, search
from tracelore.sources import sinks


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


ENTRIES = [(1, "x"), (1, "y"), (2, "y"), (2, "z"), (3, "z"), (4, "w")]
ACTIONS = [(1, "A"), (2, "B"), (3, "A"), (4, "C")]


def golden(spark):
    entries = spark.createDataFrame(ENTRIES, "entry_id long, feature string")
    acts = spark.createDataFrame(ACTIONS, "entry_id long, action string")
    queries = spark.createDataFrame([(9, "y"), (9, "z")], "query_id long, feature string")
    weights = model.document_frequency(entries, "entry_id").select("feature", ft.idf(F.lit(4), F.col("df")).alias("idf"))
    return queries, entries, acts, weights


def test_golden_neighbours(spark):
    queries, entries, acts, weights = golden(spark)
    assert rows(ranking.knn(queries, entries, acts, weights), "rank", "action", "score") == [(0, "B", 1.021651), (1, "A", 0.510826), (2, "C", 0.0)]
    got = ranking.knn(queries, entries, acts, weights)
    assert rows(got.withColumn("c", ranking.rank_confidence(F.col("rank"))), "action", "c") == [("A", -2.0), ("B", -1.0), ("C", -3.0)]
    truths = spark.createDataFrame([(9, "A"), (9, "B"), (9, "D")], "query_id long, truth string")
    assert rows(ranking.rank_of_truth(truths, got), "truth", "truth_rank") == [("A", 1), ("B", 0), ("D", -1)]
    assert rows(sinks.shown(got), "line")[0] == ("0.0000 C",)


def test_forest_without_limit_is_exact(spark):
    queries, entries, acts, weights = golden(spark)
    asked = queries.select(F.col("query_id").alias("entry_id"), "feature")
    sigs = forest.signatures(entries, acts.select("entry_id"))
    q = forest.signatures(asked, asked.select("entry_id").distinct()).withColumnRenamed("entry_id", "query_id")
    found = forest.candidates(q, sigs, most=10**9).select("entry_id").distinct()
    assert rows(found, "entry_id") == [(1,), (2,), (3,), (4,)]
    assert all(len(s) == 9 for _, s in rows(sigs, "trie", "signature"))


def test_forest_levels_against_brute_force(spark):
    import random

    r = random.Random(3)
    depth = 5
    entries = [(i, t, "".join(r.choice("01") for _ in range(depth))) for i in range(40) for t in range(3)]
    queries = [(100 + i, t, "".join(r.choice("01") for _ in range(depth))) for i in range(6) for t in range(3)]
    e, q = spark.createDataFrame(entries, "entry_id long, trie int, signature string"), spark.createDataFrame(queries, "query_id long, trie int, signature string")
    for most in (1, 5, 20, 1000):
        want = set()
        for k in {x[0] for x in queries}:
            level = {}
            for _, t, s in (x for x in queries if x[0] == k):
                own = {i: next((d for d in range(depth) if s[d] != z[d]), depth) for i, u, z in entries if u == t}
                last = next((d for d in range(depth) if sum(v >= d for v in own.values()) <= 1), depth)
                level |= {(i, t): min(v, last) for i, v in own.items()}
            want |= {(k, i, t, v) for (i, t), v in level.items() if sum(x > v for x in level.values()) < most}
        assert set(rows(forest.candidates(q, e, depth=depth, most=most), "query_id", "entry_id", "trie", "level")) == want


def test_instance_without_features_has_odd_bits(spark):
    none = spark.createDataFrame([], "entry_id long, feature string")
    got = forest.signatures(none, spark.createDataFrame([(1,)], "entry_id long"), tries=2, depth=4)
    assert rows(got, "trie", "signature") == [(0, "0000"), (1, "0000")]


def test_dense_sequence_and_window(spark):
    df = spark.createDataFrame([(k,) for k in (5, 900, 17, 1, 10**12)], "k long")
    assert rows(model.dense_sequence(df, "k", buckets=3), "k", "seq") == [(1, 1), (5, 2), (17, 3), (900, 4), (10**12, 5)]
    assert model.dense_sequence(df.limit(0), "k").count() == 0
    feats = spark.createDataFrame([(s, f"f{s % 3}") for s in range(1, 60)], "seq long, feature string")
    got = {s: (d, n) for s, d, n in rows(model.sliding_frequency(feats, width=7), "seq", "df", "n")}
    assert got == {s: (sum(t % 3 == s % 3 for t in range(max(1, s - 7), s)), min(s - 1, 7)) for s in range(1, 60)}
    unlimited = model.sliding_frequency(feats, width=10**6)
    assert rows(unlimited.groupBy("feature").agg(F.max("df") + 1), "feature", "(max(df) + 1)") == rows(model.document_frequency(feats.withColumnRenamed("seq", "i"), "i"), "feature", "df")


def test_learners(spark):
    facts = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "action string, seq long")
    oldest, newest = model.OrderLearner("oldest"), model.OrderLearner("newest")
    for x in (oldest, newest):
        model.register(x.order, x)
        x.learn(facts)
    assert model.current() is newest
    assert rows(newest.predict(facts), "rank", "action") == [(0, "a"), (1, "b"), (2, "a")]
    assert rows(oldest.predict(facts), "rank", "seq") == [(0, 1), (1, 2), (2, 3)]
    assert model.OrderLearner("none", facts).predict(facts).count() == 0
    assert len(rows(model.OrderLearner("random", facts).predict(facts), "rank")) == 3
    assert oldest.evaluate() == 0.0
    assert rows(model.per_outcome(spark.createDataFrame([(1, [4, 5]), (2, [])], "step long, outcomes array<int>")), "step", "outcome") == [(1, 4), (1, 5)]


def test_suggestions(spark):
    kind = "query_id long, rank int, solves boolean, progresses boolean"
    some = spark.createDataFrame([(1, 0, False, True), (1, 1, True, True), (1, 2, True, True), (1, 3, True, True), (2, 0, False, True), (2, 1, False, False), (2, 2, False, True), (2, 3, False, True)], kind)
    assert rows(ranking.suggested(some, p=2), "query_id", "rank", "suggestion") == [(1, 1, 1), (1, 2, 2), (2, 0, 1), (2, 2, 2)]
    assert rows(ranking.suggested(some, p=2, q=1), "query_id", "rank") == [(1, 0), (2, 0)]


def test_rebinding_and_concatenation(spark):
    uses = spark.createDataFrame([(1, 7, "h"), (1, 7, "k"), (2, 7, "h")], "query_id long, entry_id long, name string")
    stored = spark.createDataFrame([(7, "h", "nat"), (7, "h", "eq")], "entry_id long, name string, feature string")
    current = spark.createDataFrame([(1, "a", "nat"), (1, "b", "eq"), (1, "b", "nat")], "query_id long, hyp string, feature string")
    weights = spark.createDataFrame([("nat", 1.0), ("eq", 2.0)], "feature string, idf double")
    assert rows(ranking.rebound(uses, stored, current, weights), "query_id", "name", "replacement") == [(1, "h", "b"), (1, "k", "k"), (2, "h", "h")]
    kind = "query_id long, action string, rank int, confidence double"
    both = ranking.concatenated(spark.createDataFrame([(1, "a", 0, 2.0)], kind), spark.createDataFrame([(1, "z", 0, 9.0)], kind))
    assert rows(both, "rank", "action", "confidence") == [(0, "a", 2.0), (1, "z", -math.inf)]
    assert ranking.first_situation(spark.createDataFrame([(1, 0), (1, 1)], "q long, situation int")).count() == 1


def complete(spark, n):
    return spark.createDataFrame([("s", i, -0.5 * (i + 1), "s") for i in range(n)], "state string, rank int, confidence double, next string")


def test_diagonal_budget(spark):
    starts = spark.createDataFrame([("s",)], "start string")
    got = search.diagonal(spark, complete(spark, 8), starts, budget=8)
    assert got.count() == 256 and got.where("spent > 8").count() == 0
    cut = complete(spark, 8).withColumn("confidence", F.when(F.col("rank") > 0, float("-inf")).otherwise(0.0))
    assert search.diagonal(spark, cut, starts, budget=8).count() == 9


def test_deepening_and_cheapest(spark):
    starts = spark.createDataFrame([("s",)], "start string")
    succ = complete(spark, 3)
    find = lambda b: search.diagonal(spark, succ, starts, budget=b)
    budget, found = search.iterative(find, lambda r: r.where("path = ',2,2,2'"), start=7)
    assert budget == 9 and found.count() == 1
    only = spark.createDataFrame([("s", 0, -1.0, "end")], "state string, rank int, confidence double, next string")
    assert search.iterative(lambda b: search.diagonal(spark, only, starts, budget=b), lambda r: r.where("false"), start=2)[1] is None
    with pytest.raises(search.GaveUp):
        search.iterative(find, lambda r: r.where("false"), start=2, rounds=3)
    with pytest.raises(ValueError):
        search.cheapest(spark, succ.withColumn("confidence", F.lit(0.0)), starts, budget=1.0)
    assert not [t for t in spark.catalog.listTables() if "successors" in t.name]
    near = search.cheapest(spark, succ, starts, budget=1.2)
    assert rows(near, "path") == [("",), (",0",), (",0,0",), (",1",)]
    assert search.next_budget(near, succ, 1.2) == pytest.approx(1.2 + 0.3 + 1)


def test_commit_witness_cache_closure(spark):
    sols = spark.createDataFrame([(1, 0, True), (1, 1, True), (2, 0, False), (2, 1, False)], "goal long, rank int, independent boolean")
    assert rows(search.committed(sols), "goal", "rank") == [(1, 0), (2, 0), (2, 1)]
    steps = spark.createDataFrame([(1, 1, 0, "auto", 3), (1, 0, 1, "intro", 0)], "path_id long, at int, focus int, action string, rank int")
    (w,) = search.witness(steps).collect()
    assert w["witness"] == "only 2: intro; only 1: auto" and w["trace"] == [0, 3]
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)], "src long, dst long")
    assert search.closure(spark, chain, spark.createDataFrame([(80,)], "node long")).count() == 21
    assert search.closure(spark, chain, spark.range(100).toDF("node")).count() == 101 * 100 // 2 + 100
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4)], "src long, dst long")
    assert rows(search.closure(spark, edges, spark.createDataFrame([(1,), (4,), (5,)], "node long")), "node", "reached") == [(1, 1), (1, 2), (1, 3), (4, 4), (5, 5)]


def test_evaluation_protocols(spark):
    facts = [(s, (s - 1) // 2, (s - 1) // 6, "Original" if s % 5 else "Substituted", "abc"[s * s % 3]) for s in range(1, 40)]
    inst = spark.createDataFrame(facts, "seq long, step long, lemma long, status string, action string")
    feats = [(s, f) for s, *_ in facts for f in {f"a{s % 4}", f"b{s % 3}", "all"}]
    width = 9
    sets = {}
    for s, f in feats:
        sets.setdefault(s, set()).add(f)
    can = {"intra": lambda d, q: d[0] < q[0], "intrab": lambda d, q: d[1] < q[1], "inter": lambda d, q: d[2] != q[2], "real": lambda d, q: d[2] != q[2] and d[3] == "Original"}
    for protocol, ok in can.items():
        want = []
        for q in facts:
            past = [d for d in facts if q[0] - width <= d[0] < q[0]]
            n, df = len(past), {}
            for d in past:
                for f in sets[d[0]]:
                    df[f] = df.get(f, 0) + 1
            best = {}
            for d in past:
                if ok(d, q):
                    score = sum(math.log((1 + n) / (1 + df[f])) for f in sets[q[0]] & sets[d[0]])
                    best[d[4]] = max(best.get(d[4], 0.0), score)
            order = sorted(best, key=lambda a: (-round(best[a], 6), a))
            want.append((q[0], order.index(q[4]) if q[4] in order else -1))
        got = evaluation.prequential(inst, spark.createDataFrame(feats, "seq long, feature string"), protocol=protocol, width=width)
        assert rows(got, "seq", "truth_rank") == want, protocol
    with pytest.raises(ValueError):
        evaluation.seen("other")


def test_matrix_is_ragged(spark, tmp_path):
    r = spark.createDataFrame([("a", 1, 0), ("a", 5, -1), ("b", 2, 3)], "column string, seq long, truth_rank int")
    m = evaluation.matrix(r, ["a", "b"])
    assert rows(m, "row", "a", "b") == [(1, "0", "3"), (2, "-1", "")]
    sinks.write_tsv(m.orderBy("row").coalesce(1), str(tmp_path / "eval"))
    (part,) = (tmp_path / "eval").glob("part-*")
    assert part.read_text() == "row\ta\tb\n1\t0\t3\n2\t-1\t\n"
    runs = spark.createDataFrame([("l", 1.0, 5, 2, True), ("m", 2.0, 50, 2, True), ("n", 2.0, 5, 2, None)], "lemma string, time double, inferences int, predictions int, solved boolean")
    assert rows(evaluation.outcomes(runs, budget=10), "lemma", "solved") == [("l", True), ("m", False), ("n", False)]


def test_lineage(spark):
    printed = ["admit", "synth", "synthesis", "SYNTH WITH CACHE x", "fix y", "cofix", "exact_no_checK t", "apply", None]
    df = spark.createDataFrame([(i, p, i == 7) for i, p in enumerate(printed)], "i int, printed string, ignored boolean")
    assert rows(lineage.recorded(df), "i") == [(2,), (7,), (8,)] and rows(lineage.recorded(df, ignored="ignored"), "i") == [(2,), (8,)]
    assert rows(lineage.recorded(df, scope_words=("app",)), "i") == [(2,), (8,)]
    before, after = spark.createDataFrame([(1, "a"), (2, "b")], "state_id long, state string"), spark.createDataFrame([(1, 1, "y"), (1, 0, "x")], "state_id long, ord int, state string")
    assert rows(lineage.paired(before, after), "state", "after") == [("a", ["x", "y"]), ("b", [])]
    lib = spark.createDataFrame([("n", "n"), ("m", "n")], "canonical string, name string")
    assert lineage.replayed(lib).count() == 1 and lineage.replayed(lib, recording=False).count() == 0
    consts = spark.createDataFrame([(1, "s", "T", True), (1, "k", "T", True), (2, "s", "T", False)], "step long, const string, type string, opaque boolean")
    marked, hyps = lineage.inlined(consts, spark.createDataFrame([("k",)], "const string"), spark.createDataFrame([(1, "h", "P")], "step long, hyp string, type string"))
    assert rows(marked, "step", "const", "kind") == [(1, "k", "Const"), (1, "s", "Var"), (2, "s", "Const")] and hyps.count() == 2
    assert rows(lineage.captured(spark.createDataFrame([("S", "t", 1, "old"), ("S", "t", 2, "new")], "section string, name string, ord int, body string")), "body") == [("new",)]
    tries = spark.createDataFrame([("n", 0, "k0"), ("n", 1, "k1"), ("n", 2, "k2")], "notation string, counter int, key string")
    assert rows(lineage.notation_key(tries, spark.createDataFrame([("k2",), ("k1",)], "key string")), "notation", "counter", "key") == [("n", 1, "k1")]


def test_actions(spark):
    args = spark.createDataFrame([(1, 0, 0, "x", "local"), (1, 0, 1, "G", "global"), (1, 1, 0, "v", "section")], "tree_id long, ord int, place int, arg string, sort string")
    one = actions.one_variable(args)
    assert rows(one, "ord", "arg", "exact") == [(0, "G", False), (1, "v", True)]
    t = spark.createDataFrame([("?, ? end", ["a", "b"]), ("?", []), ("no", ["a"]), ("?", ["a"])], "template string, args array<string>")
    assert [r["filled"] for r in actions.filled(t).collect()] == ["a, b end", None, None, "a"]
    assert actions.round_trip_failures(args).count() == 0
    modes = actions.policy(spark, ["Then", "Atom"], {"Atom": "Both"})
    nodes = spark.createDataFrame([("Then",), ("Atom",), ("Try",), ("Id",), ("New",)], "kind string")
    assert rows(actions.annotated(nodes, modes), "kind", "outer", "descend") == [("Atom", True, True), ("Id", False, False), ("New", True, False), ("Then", False, True), ("Try", False, True)]
    with pytest.raises(ValueError):
        actions.policy(spark, [], {"x": "Sometimes"})
    atoms = spark.createDataFrame([(1, "generalize", None, ["a", "b"]), (2, "rewrite", "!", ["e"])], "step long, action string, multiplicity string, args array<string>")
    assert rows(actions.split_compound(atoms), "step", "at", "said") == [(1, 0, "generalize b"), (1, 1, "generalize a"), (2, 0, "rewrite! e")]


def test_text_features(spark):
    df = spark.createDataFrame([(1, " a b  a\nb "), (2, None), (3, "x")], "i int, t string").select("i", ft.spine(ft.words(F.col("t"))).alias("f"))
    assert rows(ft.counted(df, ["i"], "f"), "i", "feature", "cnt") == [(1, "a", 2), (1, "a-b", 1), (1, "b", 2), (1, "b-a", 2), (3, "x", 1)]
    h = spark.createDataFrame([([("x", None, "nat"), ("y", "0", "nat")],)], "h array<struct<name:string,body:string,type:string>>")
    got = h.select(ft.rendered(F.col("h"), F.lit("G")).alias("r"), ft.sexpr(F.col("h"), F.lit("G")).alias("s"), ft.map_hypotheses(F.col("h"), F.upper, lambda b: F.concat(b, b)).alias("m")).first()
    assert got["r"] == "x : nat, y := 0 : nat |- G" and got["s"] == "(State (Goal G) (Hypotheses ((x nat) (y nat 0))))"
    assert [tuple(m) for m in got["m"]] == [("x", None, "NAT"), ("y", "00", "NAT")]


def test_normal_form_and_strategies(spark):
    nodes = spark.createDataFrame([(1, 0, "Const", "plus", "file:3"), (1, 1, "Var", "x", None)], "tree_id long, node_id long, kind string, symbol string, loc string")
    full = actions.normalized(nodes, spark.createDataFrame([("plus", "Nat.plus")], "symbol string, full string"))
    assert "loc" not in full.columns and rows(full, "node_id", "symbol") == [(0, "Nat.plus"), (1, "x")]
    assert rows(actions.preorder(full), "text") == [("Const:Nat.plus Var:x",)]
    search.register("first", search.diagonal)
    search.register("second", search.cheapest)
    assert search.strategy() is search.cheapest
    assert rows(ranking.interleaved(spark.createDataFrame([(1, "b", 1), (1, "a", 1), (1, "a", 2)], "query_id long, stream string, place int")), "rank", "stream") == [(0, "a"), (1, "b"), (2, "a")]
    goals, deps = spark.createDataFrame([("g",)], "goal string"), spark.createDataFrame([("g", "a"), ("g", "b")], "src string, dst string")
    done = spark.createDataFrame([("a", True), ("b", False)], "goal string, solved boolean")
    assert rows(search.unsolved(goals, done, deps), "goal") == [("b",)]


def test_evaluation_shuffles_instances_and_features_once(spark):
    """No join of instances by feature: what is shuffled are rows, not pairs; all columns come of one pass."""
    inst = spark.createDataFrame([(s, s, s // 3, "Original", "ab"[s % 2]) for s in range(1, 30)], "seq long, step long, lemma long, status string, action string")
    feats = spark.createDataFrame([(s, k, "all") for s in range(1, 30) for k in "xy"], "seq long, kind string, feature string")
    got = evaluation.compared(inst, feats, {f"{p}-{k}": (p, k) for p in evaluation.PROTOCOLS for k in "xy"}, width=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 29 and "Join" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_evaluation_with_unknown_values(spark):
    """What is null was not seen, is no prediction that can be right, and ranks last; an instance without features is ranked too."""
    kind = "seq long, step long, lemma string, status string, action string"
    inst = spark.createDataFrame([(1, 1, "l", None, None), (2, 2, None, "Original", "b"), (3, None, "m", "Original", "a"), (4, 4, "n", "Original", "b"), (5, 5, "o", "Original", None)], kind)
    feats = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x"), (4, "y"), (4, "x")], "seq long, feature string")
    want = {"intra": [-1, -1, -1, 0, -1], "intrab": [-1, -1, -1, 0, -1], "inter": [-1, -1, -1, -1, -1], "real": [-1, -1, -1, -1, -1]}
    for protocol, ranks in want.items():
        assert [r for _, r in rows(evaluation.prequential(inst, feats, protocol=protocol), "seq", "truth_rank")] == ranks, protocol


def test_numeric_hashes_are_those_of_md5():
    import hashlib

    import pyarrow as pa

    from tracelore.functions.hashing import seeded_heads

    tokens = ["", "a", "straße", "x" * 49, "x" * 50, "y" * 51, "z" * 200]
    want = [[int(hashlib.md5(f"{s}:{t}".encode()).hexdigest()[:8], 16) for s in (0, 7, 10008)] for t in tokens]
    assert seeded_heads([0, 7, 10008], pa.array(["skip", *tokens])[1:], step=2).tolist() == want


def test_forest_ranking_in_parts_is_that_of_all_pairs(spark):
    """Parts of a few rows each, so that prefixes are cut up; every entry asks."""
    import random

    r = random.Random(5)
    acts = [(i, r.choice(["a", "b", None])) for i in range(30)]
    feats = [(i, w) for i in range(29) for w in {r.choice("klmnopqrst") for _ in range(4)}]
    e, f = spark.createDataFrame(acts, "entry_id long, action string"), spark.createDataFrame(feats, "entry_id long, feature string")
    kept = sinks.tables(spark, "test")
    sigs = kept(forest.signatures(f, e, tries=3, depth=4))
    q = sigs.withColumnRenamed("entry_id", "query_id")
    found = forest.candidates(q, sigs, depth=4, most=8).select("query_id", "entry_id").distinct().collect()
    own, df = {}, {}
    for i, w in feats:
        own.setdefault(i, set()).add(w)
        df[w] = df.get(w, 0) + 1
    best = {}
    for k, i in found:
        key, score = (k, dict(acts)[i]), sum(math.log(31 / (1 + df[w])) for w in own.get(k, set()) & own.get(i, set()))
        best[key] = max(best.get(key, 0.0), score)
    got = forest.ranking(q, sigs, f, f, e, kept, depth=4, most=8, part=3)
    assert {(x["query_id"], x["action"]): x["score"] for x in got.collect()} == pytest.approx(best, abs=1e-6)
    assert {k for k, _ in best} == set(range(30))


def test_neighbours_are_not_joined_by_feature(spark):
    """A feature that all queries have must not bring them into one task: the model goes to the queries."""
    entries = spark.createDataFrame([(1, "all"), (1, "x"), (2, "all")], "entry_id long, feature string")
    acts = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (3, None)], "entry_id long, action string")
    weights = spark.createDataFrame([("all", 0.0), ("x", 2.0), ("z", 1.0)], "feature string, idf double")
    queries = spark.createDataFrame([(7, "all"), (7, "x"), (8, "z"), (9, "all"), (9, None)], "query_id long, feature string")
    for got in (ranking.knn(queries, entries, acts, weights), ranking.overlap_scores(queries, entries, weights)):
        assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert rows(ranking.overlap_scores(queries, entries, weights), "query_id", "entry_id", "score") == [(7, 1, 2.0), (7, 2, 0.0), (9, 1, 0.0), (9, 2, 0.0)]
    assert rows(ranking.knn(queries, entries, acts, weights), "query_id", "rank", "action", "score")[:6] == [(7, 0, "A", 2.0), (7, 1, "B", 0.0), (7, 2, "C", 0.0), (8, 0, "A", 0.0), (8, 1, "B", 0.0), (8, 2, "C", 0.0)]
    assert rows(ranking.knn(queries, entries, acts, weights, unmet=False), "query_id", "rank", "action") == [(7, 0, "A"), (7, 1, "B"), (9, 0, "A"), (9, 1, "B")]
    assert ranking.knn(queries, entries.limit(0), acts.limit(0), weights).count() == 0


def test_counts_of_a_row_are_not_shuffled(spark):
    """Keys that several rows have, null ones too, are added up; the others' tokens stay where they are."""
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (2, ["b", "c"]), (None, ["d"]), (None, ["d", "e", "d"]), (3, []), (4, None)], "i int, f array<string>")
    got = ft.counted(df, ["i"], "f")
    assert sorted(map(str, got.collect())) == sorted(map(str, [r for r in spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "b", 2), (2, "c", 1), (None, "d", 3), (None, "e", 1)], "i int, feature string, cnt long").collect()]))
    plain = df.select("i", F.explode("f").alias("feature")).groupBy("i", "feature").agg(F.count(F.lit(1)).alias("cnt"))
    assert rows(got.where("i is not null"), "i", "feature", "cnt") == rows(plain.where("i is not null"), "i", "feature", "cnt")
    alone = spark.range(200).select("id", F.array_repeat(F.lit("x"), 5).alias("f"))
    counts = ft.counted(alone, ["id"], "f")
    assert counts.where("cnt = 5").count() == 200 and "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_candidates_are_joined_in_as_many_tasks_as_a_shuffle_has(spark):
    e = spark.createDataFrame([(i, 0, "01"[i % 2] * 2) for i in range(9)], "entry_id long, trie int, signature string")
    got = forest.candidates(e.withColumnRenamed("entry_id", "query_id"), e, depth=2, most=3)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2
