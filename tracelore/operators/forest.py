"""A forest of one-bit min-hash tries, as signature columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import numbers, spans
from ..functions.features import idf_of
from ..functions.hashing import rounded, seeded_heads
from .model import dense_sequence, document_frequency
from .ranking import ranked


def seeds(tries: int, depth: int) -> list[tuple[int, int, int]]:
    """(trie, level, seed): the seeds are fixed, so a forest is the same every time."""
    return [(t, d, 1000 * t + d) for t in range(tries) for d in range(depth)]


def signatures(features: DataFrame, instances: DataFrame, *, tries: int = 11, depth: int = 9, key: str = "entry_id", feature: str = "feature") -> DataFrame:
    """(key, trie, signature): a bit string a trie, a bit being whether the least hash under the level's seed is even.

    An instance without features has the largest hash, an odd one, everywhere. Features are dealt and sorted by instance and hashed in
    batches, each distinct one of a batch once; a feature that is listed twice has the same minima.
    """
    numbers = [s for _, _, s in seeds(tries, depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, least = None, None  # the instance that goes on in the next batch, and its minima so far
        for whole in gathered(batches):
            listed = whole.column(1).dictionary_encode()
            heads = seeded_heads(numbers, listed.dictionary)
            keys = whole.column(0).to_numpy()
            starts = np.flatnonzero(np.diff(keys, prepend=keys[0] - 1))
            at = listed.indices.to_numpy()
            minima = np.stack([np.minimum.reduceat(heads[:, k][at], starts) for k in range(len(numbers))], axis=1)
            keys = keys[starts]
            if last is not None and keys[0] == last:
                minima[0] = np.minimum(minima[0], least)
            elif last is not None:
                yield strings(np.array([last]), least[None, :])
            last, least = keys[-1], minima[-1]
            yield strings(keys[:-1], minima[:-1])
        if last is not None:
            yield strings(np.array([last]), least[None, :])

    def strings(keys: np.ndarray, minima: np.ndarray) -> pa.RecordBatch:
        bits = np.where(minima % 2 == 0, ord("1"), ord("0")).astype(np.uint8).tobytes().decode()
        each = pa.array([bits[i : i + depth] for i in range(0, len(bits), depth)], pa.string())
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(np.arange(len(keys) + 1, dtype=np.int32) * tries, each)], names=["k", "signatures"])

    # as many tasks as for any shuffle: adaptive execution would see few bytes and not the work
    known = features.where(F.col(key).isNotNull() & F.col(feature).isNotNull()).select(F.col(key).cast("long").alias("k"), feature)
    dealt = known.repartition(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), "k").sortWithinPartitions("k")
    hashed = dealt.mapInArrow(run, "k long, signatures array<string>")
    none = F.array(*(F.lit("0" * depth) for _ in range(tries)))
    every = instances.select(key).join(hashed, F.col(key).cast("long") == F.col("k"), "left").select(key, F.posexplode(F.coalesce("signatures", none)).alias("trie", "signature"))
    return every.select(key, "trie", "signature")


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about that many."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held += [b] if b.num_rows else []
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def prefix_counts(sigs: DataFrame, depth: int) -> DataFrame:
    """(trie, d, prefix, n): how many entries share each prefix; at most tries * (2 ** (depth + 1) - 1) rows."""
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.struct(d.alias("d"), F.substring("signature", F.lit(1), d).alias("prefix"))))
    whole = sigs.groupBy("trie", "signature").agg(F.count(F.lit(1)).alias("n"))
    return whole.select("trie", "n", cut.alias("p")).groupBy("trie", "p.d", "p.prefix").agg(F.sum("n").alias("n"))


def visits(queries: DataFrame, entries: DataFrame, *, depth: int = 9, most: int = 1000, query: str = "query_id", entry: str = "entry_id") -> tuple[DataFrame, DataFrame]:
    """What a query finds when it visits all tries in step from the deepest level up, and takes whole levels until it has `most` or
    more, counting an entry once for each trie: (query, trie, last, deep, d, prefix) and (entry, trie, signature, d, prefix), which are to
    be joined by (trie, d, prefix).

    In a trie, an entry's level is the length of the prefix it shares with the query, but no deeper than where the query's
    prefix is shared by one entry at most. How many entries each level has is read from the prefix counts (a table of
    bounded size), so only entries that are taken are joined.
    """
    counts = F.broadcast(prefix_counts(entries, depth))
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda d: F.struct(d.alias("d"), F.substring("signature", F.lit(1), d).alias("prefix"))))
    path = queries.select(query, "trie", "signature", cut.alias("p")).select(query, "trie", "signature", F.col("p.d").alias("d"), F.col("p.prefix").alias("prefix"))
    sized = path.join(counts, ["trie", "d", "prefix"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    by_trie = sized.groupBy(query, "trie").agg(F.array_sort(F.collect_list(F.struct("d", "n", "prefix"))).alias("p"))
    floor = F.array_min(F.transform(F.filter("p", lambda x: (x["n"] <= 1) | (x["d"] == depth)), lambda x: x["d"]))
    by_trie = by_trie.withColumn("last", floor)
    # entries taken if the visit stops at level l: those that share l characters, in tries whose query goes as deep
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda l: F.struct(l.alias("l"), F.when(l <= F.col("last"), F.element_at("p", l + 1)["n"]).otherwise(0).alias("n"))))  # noqa: E741
    reach = by_trie.select(query, at.alias("x")).groupBy(query, F.col("x.l").alias("l")).agg(F.sum("x.n").alias("n"))
    stop = reach.groupBy(query).agg(F.coalesce(F.max(F.when(F.col("n") >= most, F.col("l"))), F.lit(0)).alias("stop"))
    asked = by_trie.join(stop, query).where("stop <= last").select(query, "trie", "last", F.element_at("p", F.col("last") + 1)["prefix"].alias("deep"), F.col("stop").alias("d"))
    asked = asked.withColumn("prefix", F.substring("deep", F.lit(1), F.col("d")))
    used = [tuple(r) for r in asked.select("trie", "d").distinct().collect()]  # at most tries * (depth + 1)
    depths: dict[int, list[int]] = {}
    for t, d in used:
        depths.setdefault(t, []).append(d)
    wanted = F.array().cast("array<int>") if not used else F.coalesce(*(F.when(F.col("trie") == t, F.array(*map(F.lit, sorted(ds)))) for t, ds in sorted(depths.items())))
    offered = entries.select(entry, "trie", "signature", F.explode(wanted).alias("d")).withColumn("prefix", F.substring("signature", F.lit(1), F.col("d")))
    return asked, offered


def candidates(queries: DataFrame, entries: DataFrame, *, depth: int = 9, most: int = 1000, query: str = "query_id", entry: str = "entry_id") -> DataFrame:
    """(query, entry, trie, level): all that visits() finds."""
    asked, offered = visits(queries, entries, depth=depth, most=most, query=query, entry=entry)
    at = ["trie", "d", "prefix"]
    # as many tasks as for any shuffle: adaptive execution would see few bytes, and not the pairs that come of them
    tasks = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = asked.repartition(tasks, *at).join(offered.repartition(tasks, *at), at)
    # prefixes that are equal: all up to where the two part
    shared = sum(((F.substring("deep", 1, d) == F.substring("signature", 1, d)) & (F.length("deep") >= d)).cast("int") for d in range(1, depth + 1))
    return met.select(query, entry, "trie", F.least(shared, F.col("last")).alias("level"))


def ranking(queries: DataFrame, entries: DataFrame, query_features: DataFrame, entry_features: DataFrame, actions: DataFrame, kept: Callable[[DataFrame], DataFrame], *, depth: int = 9, most: int = 1000, part: int = 4000, query: str = "query_id", entry: str = "entry_id", feature: str = "feature", action: str = "action") -> DataFrame:
    """(query, action, score, rank): the actions of what each query finds, by the largest weight of features shared with one of their entries.

    queries, entries: signatures; query_features, entry_features: (query or entry, feature), distinct; actions: (entry, action), the instances, of
    which the weights are; kept writes a table and reads it again. Queries and entries that meet in a prefix are brought together with their
    features, which have numbers, in parts of about `part` of each; pairs are weighed and dropped there. A pair that meets in several tries has the
    same score in each.
    """
    n = actions.count()
    known = kept(document_frequency(entry_features, entry, feature))
    # written once, so that equal hashes keep their numbers
    numbers = kept(dense_sequence(known.withColumn("h", F.shiftright(F.xxhash64(feature), 2)), "h", "id").select(feature, F.col("id").cast("int").alias("id"), F.col("df").cast("int").alias("df")))
    ids = lambda rows, k: rows.join(numbers, feature).groupBy(k).agg(F.collect_list(F.struct("id", "df")).alias("x")).select(k, F.col("x.id").alias("ids"), F.col("x.df").alias("df"))
    mine = kept(ids(entry_features, entry))
    theirs = mine.withColumnRenamed(entry, query) if query_features is entry_features else ids(query_features.withColumnRenamed(entry, query), query)
    asked, offered = visits(queries, entries, depth=depth, most=most, query=query, entry=entry)
    at = ["trie", "d", "prefix"]
    asked = kept(asked.select(query, *at))
    offered = offered.select(entry, *at)
    sizes = lambda x, name: x.groupBy(*at).agg((F.floor((F.count(F.lit(1)) - 1) / part) + 1).cast("int").alias(name))
    parts = F.broadcast(kept(sizes(asked, "rows").join(sizes(offered, "columns"), at)))  # no more than the prefixes there are
    several = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    left = asked.join(parts, at).join(theirs, query, "left").select(query, *at, F.col("ids").alias("asked"), "df", "columns", F.pmod(F.xxhash64(query), F.col("rows")).cast("int").alias("i")).withColumn("j", several("columns")).drop("columns")
    right = offered.join(parts, at).join(actions.select(entry, action), entry).join(mine.select(entry, "ids"), entry, "left").select(action, *at, "ids", "rows", F.pmod(F.xxhash64(entry), F.col("columns")).cast("int").alias("j")).withColumn("i", several("rows")).drop("rows")
    schema = T.StructType([queries.schema[query], actions.schema[action], T.StructField("score", T.DoubleType())])

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        which, label, score = best_actions(q, d, n)
        return pa.table([q[query].combine_chunks().take(pa.array(which)), d[action].combine_chunks().take(pa.array(label)), pa.array(score)], names=schema.names)

    group = [*at, "i", "j"]
    best = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(run, schema).groupBy(query, action).agg(rounded(F.max("score")).alias("score"))
    return ranked(best, query=query, action=action)


def best_actions(q: pa.Table, d: pa.Table, n: int, most: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of d that has the action, score): the largest weight that a query shares with an entry of each action, which is d's first column."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    if not q.num_rows or not d.num_rows:
        return nothing
    action = d.column(0).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    order = np.argsort(action, kind="stable")
    column = np.argsort(order, kind="stable")
    starts = np.flatnonzero(np.diff(action[order], prepend=-1))
    ids, row = numbers(d["ids"])
    by_id = np.argsort(ids, kind="stable")
    ids, row = ids[by_id], column[row[by_id]]
    asked, asks = numbers(q["asked"])
    weight = idf_of(n, numbers(q["df"])[0])
    first = np.searchsorted(ids, asked)
    many = np.searchsorted(ids, asked, "right") - first
    cost = np.maximum(len(order), np.bincount(asks, many, q.num_rows))
    scores = []
    for rows in np.split(np.arange(q.num_rows), np.flatnonzero(np.diff(np.cumsum(cost) // most)) + 1):
        low, high = np.searchsorted(asks, [rows[0], rows[-1] + 1])
        cells = np.repeat((asks[low:high] - rows[0]) * len(order), many[low:high]) + row[spans(first[low:high], many[low:high])]
        total = np.bincount(cells, np.repeat(weight[low:high], many[low:high]), len(rows) * len(order)).astype(float).reshape(len(rows), len(order))
        scores.append(np.maximum.reduceat(total, starts, axis=1))
    which = np.repeat(np.arange(q.num_rows), len(starts))
    return which, np.tile(order[starts], q.num_rows), np.concatenate(scores).ravel()
