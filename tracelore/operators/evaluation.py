"""Prequential evaluation of ranking learners, and benchmark reports."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import spans
from ..functions.features import idf_of
from ..functions.hashing import rounded
from .model import with_context

#: What a query may have seen of the last `width` instances, by protocol: all before it, those of earlier steps, those of earlier lemmas.
PROTOCOLS = ("intra", "intrab", "inter", "real")
#: What must be known of both (not null) for a protocol to compare it.
NEEDED = {"intra": (), "intrab": ("step",), "inter": ("lemma",), "real": ("lemma",)}


def seen(protocol: str, d=None, q=None) -> Column | np.ndarray:
    """Condition on d (an earlier instance) and q (a query), both structures with seq, step, lemma, status; columns of these names by default.
    Of dictionaries of arrays it makes an array."""
    d, q = F.col("d") if d is None else d, F.col("q") if q is None else q
    if protocol == "intra":
        return d["seq"] < q["seq"]
    if protocol == "intrab":
        return d["step"] < q["step"]
    own = d["lemma"] != q["lemma"]
    if protocol == "inter":
        return own
    if protocol == "real":
        return own & (d["status"] == "Original")
    raise ValueError(f"no protocol {protocol}")


def prequential(instances: DataFrame, features: DataFrame, *, protocol: str = "intra", width: int = 1000) -> DataFrame:
    """(seq, truth, truth_rank): where each instance's own action stood in the ranking made before it was learned; -1 if nowhere.

    instances: (seq, step, lemma, status, action), seq dense from 1; features: (seq, feature), distinct. The model is the last
    `width` instances before the query that the protocol lets it see; df and N are those of all last `width`
    instances. An action's score is the largest of its instances', 0 without a shared feature; ties go by action.
    """
    return compared(instances, features.select("seq", F.lit("").alias("kind"), "feature"), {"truth_rank": (protocol, "")}, width=width)


def compared(instances: DataFrame, features: DataFrame, columns: dict[str, tuple[str, str]], *, width: int = 1000) -> DataFrame:
    """(seq, truth, one column of ranks for each name in columns, which gives its protocol and kind of features), as of prequential().

    features: (seq, kind, feature). Instances and features are dealt once by block of `width`, each also to the next block; in a task all that a
    query may see stands together, and pairs of instances, of which there are up to `width` a query, are made and used there, a few queries
    at a time.
    """
    for protocol, _ in columns.values():
        if protocol not in PROTOCOLS:
            raise ValueError(f"no protocol {protocol}")
    facts = instances.select(F.col("seq").cast("long").alias("seq"), "step", "lemma", "status", "action")
    kinds = sorted({kind for _, kind in columns.values()})
    marks = features.where(F.col("kind").isin(kinds) & F.col("feature").isNotNull()).select(F.col("seq").cast("long").alias("seq"), "kind", "feature")
    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField("truth", instances.schema["action"].dataType), *(T.StructField(name, T.IntegerType()) for name in columns)])
    names = list(columns)

    def run(held: pa.Table, marked: pa.Table) -> pa.Table:
        held = held.sort_by("seq")
        queries = held.filter(pc.invert(held["context"]))
        ranks = block_ranks(held, marked, list(columns.values()), width)
        return pa.table([queries["seq"], queries["action"], *(pa.array(r, pa.int32()) for r in ranks)], names=["seq", "truth", *names])

    sides = [with_context(x, "seq", width).groupBy("block") for x in (facts, marks)]
    return sides[0].cogroup(sides[1]).applyInArrow(run, schema)


def block_ranks(held: pa.Table, marked: pa.Table, columns: list[tuple[str, str]], width: int, cells: int = 1 << 19) -> list[np.ndarray]:
    """For each (protocol, kind), the ranks of the true actions of a block's queries, those rows of held (sorted by seq) that are no context."""
    facts = {x: places(held[x]) for x in ("step", "lemma")} | {"seq": held["seq"].to_numpy(), "status": np.array(held["status"].to_pylist(), object)}
    seq, action = facts["seq"], places(held["action"])
    asked = np.flatnonzero(~held["context"].to_numpy())
    null = np.max(action, initial=-1) + 1
    action = np.where(action < 0, null, action)  # an action that is null comes after all others and equals no other
    order = np.argsort(action, kind="stable")  # columns stand by action
    column = np.argsort(order, kind="stable")
    starts = np.flatnonzero(np.diff(action[order], prepend=-1))
    classes = action[order][starts]
    d = {k: v[order][None, :] for k, v in facts.items()}
    oldest = np.searchsorted(seq, seq - width)  # rows from here to a query's own are the last `width`
    postings = {kind: shared_rows(seq, marked, kind, width) for kind in {k for _, k in columns}}
    out = [np.full(len(asked), -1, np.int32) for _ in columns]
    cost = np.maximum(len(seq), sum(met[asked] for *_, met in postings.values()))
    for part in np.split(np.arange(len(asked)), np.flatnonzero(np.diff(np.cumsum(cost) // cells)) + 1):
        rows = asked[part]
        q = {k: v[rows][:, None] for k, v in facts.items()}
        inside = (order[None, :] < rows[:, None]) & (order[None, :] >= oldest[rows][:, None])
        score = {kind: shared_weights(rows, column, *postings[kind][:-1]) for kind in postings}
        for k, (protocol, kind) in enumerate(columns):
            allowed = inside & seen(protocol, d, q)
            for x in NEEDED[protocol]:
                allowed &= (d[x] >= 0) & (q[x] >= 0)
            best = np.maximum.reduceat(np.where(allowed, score[kind], -1), starts, axis=1)
            best[:, classes == null] = np.minimum(best[:, classes == null], 0)
            own = np.searchsorted(classes, action[rows])[:, None]
            mine = np.take_along_axis(best, own, axis=1)
            before = (best >= 0) & ((best > mine) | ((best == mine) & (np.arange(len(classes)) < own)))
            out[k][part] = np.where((mine[:, 0] >= 0) & (action[rows] != null), before.sum(axis=1), -1)
    return out


def places(values: pa.ChunkedArray) -> np.ndarray:
    """Numbers that equal, and order as, the values do; -1 for null."""
    values = values.combine_chunks()
    listed = sorted(values.unique().drop_null().to_pylist())
    return pc.fill_null(pc.index_in(values, pa.array(listed, values.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def shared_rows(seq: np.ndarray, marked: pa.Table, kind: str, width: int) -> tuple[np.ndarray, ...]:
    """For each row, the features it has, and for each of them the earlier rows of the last `width` that have it too: (first feature of each row,
    first and end of its earlier rows, weight; the rows themselves by feature; how many rows it meets)."""
    mine = marked.filter(pc.equal(marked["kind"], kind))
    code = mine["feature"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    row = np.searchsorted(seq, mine["seq"].to_numpy())
    known = row < len(seq)
    known[known] = seq[row[known]] == mine["seq"].to_numpy()[known]
    pairs = np.unique(code[known] * len(seq) + row[known])  # by feature, then by row; a feature listed twice counts once
    code, row = pairs // max(1, len(seq)), pairs % max(1, len(seq))
    first = np.searchsorted(pairs, code * len(seq) + np.searchsorted(seq, seq[row] - width))
    end = np.arange(len(pairs))
    n = np.minimum(seq[row] - 1, width)
    weight = idf_of(n, end - first)
    by_row = np.argsort(row, kind="stable")
    met = np.bincount(row, end - first, len(seq)).astype(np.int64)
    return np.searchsorted(row[by_row], np.arange(len(seq) + 1)), first[by_row], end[by_row], weight[by_row], row, met


def shared_weights(rows: np.ndarray, column: np.ndarray, starts: np.ndarray, first: np.ndarray, end: np.ndarray, weight: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A matrix of rows by all rows, each in its column: millionths of the weight of the features that both have, rounded."""
    lengths = starts[rows + 1] - starts[rows]
    at = spans(starts[rows], lengths)
    asked = np.repeat(np.arange(len(rows)), lengths)
    many = end[at] - first[at]
    met = row[spans(first[at], many)]
    total = np.bincount(np.repeat(asked, many) * len(column) + column[met], np.repeat(weight[at], many), len(rows) * len(column))
    return np.rint(total.reshape(len(rows), len(column)) * 1e6).astype(np.int64)


def split(rows: DataFrame, current: str, path: str = "path") -> DataFrame:
    """in_file: whether a row is of the file under evaluation; rows of others are for training only."""
    return rows.withColumn("in_file", F.col(path).startswith(current))


def matrix(results: DataFrame, columns: list[str]) -> DataFrame:
    """(row, one column for each scheme and learner): ranks side by side in order of seq, empty where a column is shorter.

    results: (column, seq, truth_rank).
    """
    placed = results.withColumn("row", F.row_number().over(Window.partitionBy("column").orderBy("seq")))
    return placed.groupBy("row").pivot("column", columns).agg(F.first("truth_rank")).select("row", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in columns))


def outcomes(runs: DataFrame, should: DataFrame | None = None, budget: int | None = None) -> DataFrame:
    """(lemma, time, inferences, predictions, solved) of the lemmas to be benchmarked; with a budget, only what took no more inferences counts as solved."""
    rows = runs if should is None else runs.join(should.select("lemma"), "lemma", "left_semi")
    fits = F.lit(True) if budget is None else F.col("inferences") <= budget
    return rows.withColumn("solved", F.coalesce(F.col("solved") & fits, F.lit(False)))


def report(rows: DataFrame, by: str) -> DataFrame:
    """Lemmas, share solved, and means."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("lemmas"), F.sum(F.col("solved").cast("int")).alias("solved"), rounded(F.avg("time")).alias("mean_time"), F.sum("inferences").alias("inferences"), F.sum("predictions").alias("predictions"))
