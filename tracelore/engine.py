"""The engine as one object: remember what was done, suggest what to do, search, and evaluate."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.features import idf
from .operators import evaluation, forest, model, ranking, search
from .sources.sinks import shown, tables


class Engine:
    """instances: (entry_id, action); features: (entry_id, feature), distinct. The last config.window instances by entry_id are
    held for exact neighbours; the forest holds all."""

    def __init__(self, spark: SparkSession, config: Config = Config()):
        self.spark, self.config = spark, config
        self.instances: DataFrame | None = None
        self.features: DataFrame | None = None

    def set(self, **options) -> None:
        """Change options; None takes an option back to its default."""
        default = Config()
        self.config = replace(self.config, **{k: getattr(default, k) if v is None else v for k, v in options.items()})

    def remember(self, instances: DataFrame, features: DataFrame) -> None:
        if not self.config.record:
            return
        self.instances = instances if self.instances is None else self.instances.unionByName(instances)
        self.features = features if self.features is None else self.features.unionByName(features)

    def held(self) -> DataFrame:
        return model.last_instances(model.dense_sequence(self.instances, "entry_id"), width=self.config.window).select("entry_id", "action")

    def neighbours(self, queries: DataFrame, local: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
        """(query_id, action, score, rank) by exact neighbours in the window. queries: (query_id, feature); local: instances and
        features of the running session, seen by this call only."""
        held, features = self.held(), self.features
        if local is not None:
            held, features = model.overlaid(held, local[0]), model.overlaid(features, local[1])
        own = features.join(held.select("entry_id"), "entry_id")
        weights = model.document_frequency(own, "entry_id").select("feature", idf(F.lit(held.count()), F.col("df")).alias("idf"))
        return ranking.knn(queries, own, held, weights)

    def forest_ranking(self, queries: DataFrame) -> DataFrame:
        """(query_id, action, score, rank, confidence) of what the hash forest finds."""
        c = self.config
        entries = forest.signatures(self.features, self.instances, tries=c.tries, depth=c.depth)
        asked = queries.withColumnRenamed("query_id", "entry_id")
        sigs = forest.signatures(asked, asked.select("entry_id").distinct(), tries=c.tries, depth=c.depth).withColumnRenamed("entry_id", "query_id")
        best = forest.ranking(sigs, entries, queries, self.features, self.instances, tables(self.spark, "forest"), depth=c.depth, most=c.sort_window)
        return best.withColumn("confidence", ranking.rank_confidence(F.col("rank")))

    def suggest(self, queries: DataFrame, verdicts: DataFrame | None = None, *, k: int = 10) -> DataFrame:
        """The first k actions as they are printed; with verdicts (query_id, action, solves, progresses) those that solve or, if none
        does, that progress."""
        if verdicts is None:
            return shown(ranking.taken(self.neighbours(queries), k))
        judged = self.neighbours(queries).join(verdicts, ["query_id", "action"], "left").fillna(False, ["solves", "progresses"])
        return ranking.suggested(judged, p=self.config.solves, q=self.config.progresses)

    def search(self, successors: DataFrame, starts: DataFrame, solved: Callable[[DataFrame], DataFrame], *, rounds: int | None = None, seconds: float | None = None):
        """Deepen the diagonal search until a solution is found or nothing new is reached: (budget, solutions or None); GaveUp if `rounds` run out first,
        TimedOut if `seconds` do, TooDeep inside config.nesting others. With config.executions a start executes no more sequences a round."""
        c = self.config

        def reach(budget: int) -> DataFrame:
            reached = search.diagonal(self.spark, successors, starts, budget=budget)
            return reached if c.executions is None else search.executed(reached, c.executions)

        whole = lambda: search.iterative(reach, solved, start=c.start_budget, step=c.budget_step, rounds=rounds)
        return search.nested(whole if seconds is None else lambda: search.run_within(self.spark, seconds, whole), c.nesting)

    def benchmark(self, lemma: str, should: Callable[[str], bool], seconds: float, action: Callable[[], object]) -> tuple[str, object]:
        """Run an action for a lemma that is asked for, and kill it config.kill_after_s seconds after its limit."""
        return search.benchmarked(self.spark, lemma, should, seconds, action, kill_after_s=self.config.kill_after_s)

    def evaluate(self, facts: DataFrame, features: DataFrame, protocol: str = "intra") -> DataFrame:
        return evaluation.prequential(facts, features, protocol=protocol, width=self.config.window)
