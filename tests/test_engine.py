import time

import pytest
from pyspark.sql import functions as F

from tracelore.config import Config
from tracelore.engine import Engine
from tracelore.functions import trees
from tracelore.operators import actions, search
from tracelore.sources import adapters


@pytest.fixture
def engine(spark):
    e = Engine(spark, Config(window=3))
    e.remember(spark.createDataFrame([(1, "A"), (2, "B"), (3, "A"), (4, "C")], "entry_id long, action string"), spark.createDataFrame([(1, "x"), (1, "y"), (2, "y"), (2, "z"), (3, "z"), (4, "w")], "entry_id long, feature string"))
    return e


def test_window_overlay_and_options(spark, engine):
    q = spark.createDataFrame([(9, "y"), (9, "x")], "query_id long, feature string")
    top = lambda df: df.orderBy("rank").first()["action"]
    assert top(engine.neighbours(q)) == "B"  # the first instance has left the window
    local = spark.createDataFrame([(100, "L")], "entry_id long, action string"), spark.createDataFrame([(100, "x"), (100, "y")], "entry_id long, feature string")
    assert top(engine.neighbours(q, local)) == "L" and engine.instances.count() == 4
    engine.set(window=None)
    assert engine.config.window == 1000 and top(engine.neighbours(q)) == "A"
    assert top(engine.forest_ranking(q)) == "A"
    assert engine.suggest(q, k=2).count() == 2
    verdicts = spark.createDataFrame([(9, "C", True, True)], "query_id long, action string, solves boolean, progresses boolean")
    assert [r["action"] for r in engine.suggest(q, verdicts).collect()] == ["C"]
    engine.set(record=False)
    engine.remember(*local)
    assert engine.instances.count() == 4


def test_search_deepens(spark, engine):
    succ = spark.createDataFrame([("s", i, -1.0, "s") for i in range(12)], "state string, rank int, confidence double, next string")
    budget, found = engine.search(succ, spark.createDataFrame([("s",)], "start string"), lambda r: r.where("path = ',9'"))
    assert budget == 10 and found.count() == 1


def test_time_limits(spark):
    assert search.run_within(spark, 30, lambda: spark.range(5).count()) == 5
    slow = lambda: spark.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(3) or p for p in it), "id long").count()
    with pytest.raises(search.TimedOut):
        search.run_within(spark, 0.5, lambda: search.run_within(spark, 60, slow))


def test_shelved_goals_and_small_functions(spark):
    goals = spark.createDataFrame([(3,)], "n int")
    rounds = search.until_unshelved(lambda g: (g, g.where("n > 1").withColumn("n", F.col("n") - 1)), goals)
    assert [r.first()["n"] for r in rounds] == [3, 2, 1]
    t = ("App", None, [("AppFun", ("Const", "f", [])), ("AppArg", ("App", None, [("AppFun", ("Const", "g", [])), ("AppArg", ("Rel", None, []))])), ("AppArg", ("Rel", None, []))])
    assert trees.scopes(t) == [(0, 5), (1, 1), (2, 4), (3, 3), (4, 4), (5, 5)]
    nodes = spark.createDataFrame([("Var", "x"), ("Const", "c")], "kind string, symbol string")
    assert sorted(r["symbol"] for r in actions.mapped(nodes, {"Var": F.upper("symbol")}).collect()) == ["X", "c"]
    rows = spark.createDataFrame([("a", "a"), ("b", None), (None, None)], "printed string, parsed string")
    assert [r["printed"] for r in actions.unparsed(rows).collect()] == ["b"]
    assert adapters.library_file("A.B") == "A/B.eval" and adapters.seconds_of(5) == 5.0 and adapters.seconds_of(1_000_000) == 0.1


def test_limits_of_search(spark):

    assert search.nested(lambda: search.nested(lambda: 3)) == 3
    with pytest.raises(search.TooDeep):
        search.nested(lambda: search.nested(lambda: search.nested(lambda: 3)))
    assert search.nested(lambda: 4, most=1) == 4  # what failed has left nothing behind
    succ = spark.createDataFrame([("s", i, -0.5 * (i + 1), "s") for i in range(3)], "state string, rank int, confidence double, next string")
    starts = spark.createDataFrame([("s",)], "start string")
    reached = search.diagonal(spark, succ, starts, budget=4)
    assert [r["path"] for r in search.executed(reached, 3).orderBy("spent", "path").collect()] == ["", ",0", ",0,0"]
    few = Engine(spark, Config(executions=2, start_budget=2))
    assert few.search(succ, starts, lambda r: r.where("path = ',1'")) == (3, None)
    assert few.benchmark("a", lambda x: False, 1.0, lambda: 5) == ("skip", None) and few.benchmark("a", lambda x: True, 9.0, lambda: 5) == ("found", 5)
    slow = lambda: spark.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(4) or p for p in it), "id long").count()
    few.set(kill_after_s=0.3)
    assert few.benchmark("a", lambda x: True, 0.2, slow) == ("killed", None)
