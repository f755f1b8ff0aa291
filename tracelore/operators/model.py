"""Instances, document frequencies and bounded models."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_sequence(df: DataFrame, key: str, name: str = "seq", buckets: int = 512, rows_in_bucket: int = 100_000) -> DataFrame:
    """Number rows 1, 2, ... by a unique integer key, without sorting everything in one task.

    The key's span is cut into equal buckets, so many that keys that are spread evenly leave rows_in_bucket in each, and `buckets` at least; a row's number
    is the count of rows in earlier buckets and its place in its own. The counts, one a bucket, are what is broadcast. Keys that crowd in a part
    of their span make large buckets, which cost time, not rows.
    """
    low, high, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if low is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    width = (high - low) // max(buckets, n // rows_in_bucket) + 1
    tagged = df.withColumn("__b", F.floor((F.col(key) - low) / F.lit(width)))
    counts = tagged.groupBy("__b").count()
    before = counts.withColumn("__before", F.coalesce(F.sum("count").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__b", "__before")
    return tagged.join(F.broadcast(before), "__b").withColumn(name, (F.col("__before") + F.row_number().over(Window.partitionBy("__b").orderBy(key))).cast("long")).drop("__b", "__before")


def per_outcome(steps: DataFrame, outcomes: str = "outcomes") -> DataFrame:
    """One instance for each outcome of a step."""
    return steps.withColumn("outcome", F.explode(outcomes)).drop(outcomes)


def document_frequency(features: DataFrame, instance: str, feature: str = "feature") -> DataFrame:
    """In how many instances each feature stands; partial sums come before the shuffle."""
    return features.select(instance, feature).distinct().groupBy(feature).agg(F.count(F.lit(1)).alias("df"))


def with_context(df: DataFrame, seq: str, width: int) -> DataFrame:
    """Each row in its block of `width` numbers, and as context in the next block.

    A window of the last `width` numbers lies in a row's block and the one before, so windows and joins can be
    partitioned by block: no key gathers more than two blocks in a task.
    """
    block = F.floor((F.col(seq) - 1) / F.lit(width))
    return df.withColumn("__at", F.explode(F.array(F.struct(block.alias("block"), F.lit(False).alias("context")), F.struct((block + 1).alias("block"), F.lit(True).alias("context"))))).select("*", "__at.block", "__at.context").drop("__at")


def sliding_frequency(features: DataFrame, *, seq: str = "seq", feature: str = "feature", width: int = 1000) -> DataFrame:
    """For each row, df: in how many of the `width` instances before its own the feature stands (evicted ones are forgotten),
    and n: how many instances the model holds."""
    w = Window.partitionBy(feature, "block").orderBy(seq).rangeBetween(-width, -1)
    counted = with_context(features, seq, width).withColumn("df", F.count(F.lit(1)).over(w))
    return counted.where(~F.col("context")).drop("block", "context").withColumn("n", F.least(F.col(seq) - 1, F.lit(width)))


def last_instances(df: DataFrame, seq: str = "seq", width: int = 1000) -> DataFrame:
    """What a first-in first-out model of `width` instances holds after all were added."""
    newest = df.agg(F.max(seq)).first()[0]
    return df.where(F.col(seq) > F.lit((newest or 0) - width))


def overlaid(model: DataFrame, local: DataFrame) -> DataFrame:
    """The shared model with rows of the running session on top; the model itself stays as it is."""
    return model.unionByName(local, allowMissingColumns=True)


class Learner(Protocol):
    """What a learner offers: an empty model, learning rows, ranking actions for states."""

    def learn(self, instances: DataFrame) -> None: ...

    def predict(self, states: DataFrame) -> DataFrame: ...

    def evaluate(self) -> float: ...


_learners: dict[str, Learner] = {}
_current: list[str] = []


def register(name: str, learner: Learner) -> None:
    """The last one registered is current."""
    _learners[name] = learner
    _current.append(name)


def current() -> Learner:
    if not _current:
        raise LookupError("no learner is registered")
    return _learners[_current[-1]]


@dataclass
class OrderLearner:
    """Ranks actions by when they were added, newest first or oldest first, or not at all ("none"), without merging equal ones."""

    order: str = "newest"
    rows: DataFrame | None = None
    constant: float = 0.0

    def learn(self, instances: DataFrame) -> None:
        self.rows = instances if self.rows is None else self.rows.unionByName(instances)

    def ranking(self) -> DataFrame:
        """(action, seq, rank): one ranking, the same for every state; seq is dense from 1, so a rank needs no sort."""
        if self.order == "random":
            # a hash of the number, which is unique, puts rows in an order of chance; its values are spread evenly, so are the buckets
            dealt = self.rows.select("action", "seq", F.shiftright(F.xxhash64("seq"), 2).alias("h"))
            return dense_sequence(dealt, "h", "rank").select("action", "seq", (F.col("rank") - 1).alias("rank"))
        newest = self.rows.agg(F.max("seq")).first()[0] or 0
        return self.rows.select("action", "seq", (F.lit(newest) - F.col("seq") if self.order == "newest" else F.col("seq") - 1).alias("rank"))

    def predict(self, states: DataFrame) -> DataFrame:
        return self.ranking() if self.rows is not None and self.order != "none" else states.sparkSession.createDataFrame([], "action string, seq long, rank int")

    def evaluate(self) -> float:
        return self.constant
