"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches

#: Edges that one task joins up in memory.
PART = 500_000


def contracted(batches):
    """Edges (a, b) of one partition as (node, smallest node it reaches inside the partition)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if root(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) of every node of an edge (a, b); component is the smallest node that can be reached.

    Partitions of at most about PART edges are first contracted to stars, each in one task. If there is more than one, rounds
    turn every edge toward the smallest neighbour (large star, then small star), which keeps the number of edges and
    needs a logarithmic number of rounds; groups are reduced with min only, and the joins can be split by adaptive
    execution, so a node with very many edges is no bottleneck. Rounds are written to the shared folder. Null ends and
    loops are ignored. No edges, no rows.
    """
    spark = edges.sparkSession
    small_batches(spark)
    whole = scratch.save(edges.select("a", "b").where("a is not null and b is not null and a <> b"), f"{name}-edges", small=True)
    parts = max(1, math.ceil(whole.count() / PART))
    now = scratch.save(whole.coalesce(parts).mapInArrow(contracted, "a long, b long"), f"{name}-0")
    scratch.drop(f"{name}-edges")
    i = 0

    def total(df: DataFrame):
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())

    before = total(now) if parts > 1 else None
    while parts > 1:
        # large star: neighbours above a node go to its smallest neighbour (or itself)
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").where("a <> b").distinct()
        i += 1
        now = scratch.save(small, f"{name}-{i}", small=True)
        scratch.drop(f"{name}-{i - 1}")
        after = total(now)
        if after == before:
            break
        before = after
    # every node but the smallest of its component now has one edge, to that one
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
