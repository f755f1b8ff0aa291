"""Budgeted search over ranked successors, as recursive queries."""

from __future__ import annotations

import itertools
import math
import threading
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.sinks import tables

_strategies: list[tuple[str, Callable[..., DataFrame]]] = []


def register(name: str, strategy: Callable[..., DataFrame]) -> None:
    """The strategy registered last is the one in use."""
    _strategies.append((name, strategy))


def strategy() -> Callable[..., DataFrame]:
    if not _strategies:
        raise LookupError("no search strategy is registered")
    return _strategies[-1][1]


@contextmanager
def _named(**frames: DataFrame):
    """Temporary views of the frames under names of their own, so that searches of one session do not mix."""
    own = {k: f"{k}_{uuid.uuid4().hex}" for k in frames}
    for k, df in frames.items():
        df.createOrReplaceTempView(own[k])
    try:
        yield own
    finally:
        for k, df in frames.items():
            df.sparkSession.catalog.dropTempView(own[k])


def diagonal(spark: SparkSession, successors: DataFrame, starts: DataFrame, *, budget: int = 8) -> DataFrame:
    """(start, state, path, spent, len): all sequences of choices whose sum of (rank + 1) is within the budget.

    successors: (state, rank, confidence, next); a confidence of minus infinity ends a state's choices. The empty sequence is
    included. Depth is bounded by the budget, and there is no limit on rows.
    """
    cut = successors.where(F.col("confidence") > float("-inf")).where(F.col("rank") < budget)
    with _named(successors=cut, starts=starts) as v:
        return spark.sql(f"""
        WITH RECURSIVE r MAX RECURSION LEVEL {int(budget) + 1} AS (
          SELECT start, start AS state, cast('' AS string) AS path, 0 AS spent, 0 AS len FROM {v["starts"]}
          UNION ALL
          SELECT r.start, s.next, concat(r.path, ',', cast(s.rank AS string)), r.spent + s.rank + 1, r.len + 1
          FROM r JOIN {v["successors"]} s ON s.state = r.state WHERE r.spent + s.rank + 1 <= {int(budget)})
        SELECT * FROM r LIMIT ALL""")


class GaveUp(Exception):
    """A limit of rounds was reached before the search had ended."""


def iterative(search: Callable[[int], DataFrame], solved: Callable[[DataFrame], DataFrame], *, start: int = 8, step: int = 1, rounds: int | None = None) -> tuple[int, DataFrame | None]:
    """Deepen the budget by `step` until a round has a solution: (budget, solutions), or (last budget, None) if
    a round reaches nothing that the one before did not. With `rounds`, GaveUp is raised when they run out before either."""
    budget, before = start, -1
    for i in itertools.count(1):
        reached = search(budget)
        good = solved(reached)
        if good.limit(1).count():
            return budget, good
        now = reached.count()
        if now == before:
            return budget, None
        if i == rounds:
            raise GaveUp(f"no solution within {rounds} rounds, up to budget {budget}")
        before, budget = now, budget + step


def cheapest(spark: SparkSession, successors: DataFrame, starts: DataFrame, *, budget: float) -> DataFrame:
    """(start, state, path, left, len): a choice adds its (negative) confidence to the budget; it must stay above 0.

    A choice that would not ends its state's choices, as do all of lower confidence. There is no limit on rows; paths are no longer
    than the budget allows choices of the smallest cost, which must not be 0 (ValueError).
    """
    least = successors.agg(F.max("confidence")).first()[0]
    if least is not None and least >= 0:
        raise ValueError("a choice without cost could be repeated for ever")
    most = 1 if least is None or least == float("-inf") else math.ceil(budget / -least) + 1
    with _named(successors=successors, starts=starts) as v:
        return spark.sql(f"""
        WITH RECURSIVE r MAX RECURSION LEVEL {most + 1} AS (
          SELECT start, start AS state, cast('' AS string) AS path, cast({float(budget)} AS double) AS left, 0 AS len FROM {v["starts"]}
          UNION ALL
          SELECT r.start, s.next, concat(r.path, ',', cast(s.rank AS string)), r.left + s.confidence, r.len + 1
          FROM r JOIN {v["successors"]} s ON s.state = r.state WHERE r.left + s.confidence > 0)
        SELECT * FROM r LIMIT ALL""")


def next_budget(reached: DataFrame, successors: DataFrame, budget: float) -> float | None:
    """The budget of the next round: what the least overshoot of a cut choice asks for, and one more; null if none was cut."""
    over = reached.join(successors, "state").select((F.col("left") + F.col("confidence")).alias("d")).where("d <= 0").agg(F.max("d")).first()[0]
    return None if over is None else budget - over + 1


def committed(solutions: DataFrame, *, goal: str = "goal", rank: str = "rank", independent: str = "independent") -> DataFrame:
    """A goal that shares nothing with other open ones keeps its first solution; others keep all."""
    w = Window.partitionBy(goal).orderBy(rank)
    return solutions.withColumn("__r", F.row_number().over(w)).where(~F.col(independent) | (F.col("__r") == 1)).drop("__r")


def witness(steps: DataFrame, *, path: str = "path_id", at: str = "at", focus: str = "focus", action: str = "action", rank: str = "rank") -> DataFrame:
    """(path, witness, trace): the actions taken in order, "only k: action" where k is the goal in focus, joined by ";", and their ranks."""
    said = F.concat(F.lit("only "), (F.col(focus) + 1).cast("string"), F.lit(": "), F.col(action))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), said.alias("said"), F.col(rank).alias("rank"))))
    return steps.groupBy(path).agg(ordered.alias("o")).select(path, F.array_join(F.transform("o", lambda x: x["said"]), "; ").alias("witness"), F.transform("o", lambda x: x["rank"]).alias("trace"))


def cached(goals: DataFrame, cache: DataFrame, *, key: str = "goal") -> tuple[DataFrame, DataFrame]:
    """(goals with their cached witness, goals that must be searched)."""
    return goals.join(cache, key), goals.join(cache, key, "left_anti")


def closure(spark: SparkSession, edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(node, reached): everything that can be reached over edges (src, dst), the node itself included. Cycles end, as pairs are distinct; there is no limit on the way's length.

    If every source of an edge is a start, what is reached is joined with itself, so a chain of n edges takes log2(n) rounds. Else
    that would follow edges that no start reaches, and a round goes one edge further from the pairs that are new. Rounds end when one brings
    nothing new. They are written to the shared folder, which cuts their lineage.
    """
    kept = tables(spark, "closure")
    links = kept(edges.where("src is not null and dst is not null and src <> dst").select("src", "dst").distinct())
    every = kept(starts.select("node", F.col("node").alias("reached")).distinct())
    if not links.join(every, links["src"] == every["node"], "left_anti").limit(1).count():
        every = kept(every.unionByName(links.select(F.col("src").alias("node"), F.col("dst").alias("reached"))).distinct())
        size = -1
        while (now := every.count()) != size:
            size = now
            a, b = every.alias("a"), every.alias("b")
            # a node's pair with itself keeps what is known
            further = a.join(b, F.col("a.reached") == F.col("b.node")).select(F.col("a.node").alias("node"), F.col("b.reached").alias("reached"))
            every = kept(further.unionByName(every).distinct())
        return every
    new, i = every, 0
    while True:
        new = kept(new.join(links, new["reached"] == links["src"]).select("node", F.col("dst").alias("reached")).distinct().join(every, ["node", "reached"], "left_anti"))
        if not new.limit(1).count():
            return every
        i += 1
        every = every.unionByName(new) if i % 16 else kept(every.unionByName(new))


def unsolved(before: DataFrame, after: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Open goals that a claimed solution leaves: what the goals before depend on, less what is solved after."""
    return before.join(dependencies, before["goal"] == dependencies["src"]).select(F.col("dst").alias("goal")).distinct().join(after.where("solved").select("goal"), "goal", "left_anti")


def within(column: Column, budget: int | None) -> Column:
    """Deterministic benchmarks count inferences instead of seconds."""
    return F.lit(True) if budget is None else column <= budget


def until_unshelved(search_round, goals: DataFrame, rounds: int | None = None) -> list[DataFrame]:
    """Search again for what a round shelved, until nothing is; the solutions of each round. search_round returns (solutions, shelved goals).
    With `rounds`, GaveUp is raised if goals are shelved still when they run out."""
    out = []
    for i in itertools.count(1):
        solutions, goals = search_round(goals)
        out.append(solutions)
        if not goals.limit(1).count():
            return out
        if i == rounds:
            raise GaveUp(f"goals are still shelved after {rounds} rounds")


class TooDeep(Exception):
    """A search inside searches went deeper than is allowed."""


def nested(action: Callable[[], object], most: int = 2):
    """Run a search that may itself search; TooDeep when more than `most` stand inside each other."""
    depth = getattr(_local, "depth", 0)
    if depth >= most:
        raise TooDeep(f"{most} searches stand inside each other already")
    _local.depth = depth + 1
    try:
        return action()
    finally:
        _local.depth = depth


def executed(reached: DataFrame, most: int, *, start: str = "start") -> DataFrame:
    """Of each start's sequences (path, spent) the first `most` that a search of rising budget executes: by what is spent, then by path."""
    w = Window.partitionBy(start).orderBy("spent", "path")
    return reached.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def benchmarked(spark: SparkSession, lemma: str, should: Callable[[str], bool], seconds: float, action: Callable[[], object], *, kill_after_s: float = 5.0) -> tuple[str, object]:
    """("skip", None) for a lemma that is not asked for; else ("found", result), or ("killed", None) if the action has not ended by itself
    kill_after_s seconds after its own limit."""
    if not should(lemma):
        return "skip", None
    try:
        return "found", run_within(spark, seconds + kill_after_s, action)
    except TimedOut:
        return "killed", None


class TimedOut(Exception):
    """The job was cancelled when its time was up."""


def run_within(spark: SparkSession, seconds: float, action: Callable[[], object]):
    """Run an action, and cancel its Spark jobs when the time is up (TimedOut). An inner limit never outlives an outer one."""
    tag = f"within-{uuid.uuid4().hex[:8]}"
    limit = min([seconds, *_deadlines()])
    spark.sparkContext.addJobTag(tag)
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(limit, stop)
    _stack().append(time.monotonic() + limit)
    timer.start()
    try:
        return action()
    except Exception as e:
        if late.is_set():
            raise TimedOut(f"{limit:g} s") from e
        raise
    finally:
        timer.cancel()
        _stack().pop()
        spark.sparkContext.removeJobTag(tag)


_local = threading.local()


def _stack() -> list[float]:
    if not hasattr(_local, "ends"):
        _local.ends = []
    return _local.ends


def _deadlines() -> list[float]:
    return [max(0.0, end - time.monotonic()) for end in _stack()]
