"""Best-fit packing into bins of several permitted capacities."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, gathered, small_batches

#: Permitted sequence lengths, in tokens.
CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs beside its capacity, in tokens.
OVERHEAD = 16
#: Pieces of one length and salt that are numbered together: at most so many, and at most this part of all pieces.
NUMBERED, PART = 250_000, 256


@dataclass
class Placement:
    """Pieces of one length with ranks in [first, first + count) go, `per` to a bin, to bins bin, bin + 1, ... from one offset on."""

    length: int
    first: int
    count: int
    bin: int
    offset: int
    per: int


def opened(length: int, demand: dict[int, int], capacities: Sequence[int], overhead: int) -> int:
    """The capacity of least cost a token for a bin that starts with this length; demand counts what is still to be placed.

    A capacity is charged in full and credited with what best fit could still put into it: pieces of the remaining
    lengths, the largest that fits first. Of equal costs the larger capacity is opened.
    """
    best = None
    for c in sorted(capacities, reverse=True):
        if c < length:
            continue
        room, filled = c - length, length
        for k in sorted((k for k in demand if k <= room), reverse=True):
            n = min(demand[k] - (k == length), room // k)
            if n > 0:
                room -= n * k
                filled += n * k
            if not room:
                break
        # what the bin would be downsized to
        cost = (min(x for x in capacities if x >= filled) + overhead) / filled
        if best is None or cost < best[0] - 1e-12:
            best = (cost, c)
    return best[1]


def pack(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[Placement], list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over a histogram of lengths; lengths run from 1 to the largest capacity.

    Bins with the same contents are one group with a count, so work and memory depend on the number of lengths and
    capacities, not on the number of pieces: a length opens or parts a few groups at most, and a group is filled again only
    by a length that its room did not hold before, which halves that room, so there are some 12 placements for each of 6 groups a
    length, 300,000 for 4096 lengths. Returns placements, and groups (bin, count, used, capacity) where capacity
    is already the smallest permitted one that holds what is used.
    """
    todo = dict(sorted(histogram.items(), reverse=True))
    placed: list[Placement] = []
    groups: list[list[int]] = []  # bin, count, used, capacity
    free: list[tuple[int, int]] = []  # (room, number of the group), in order
    bins = 0
    def fill(length: int, rank: int, left: int, g: int) -> int:
        """Pieces of one length into the bins of a group; a bin that took one is the tightest still and takes all that fit."""
        start, count, used, capacity = groups[g]
        per = min((capacity - used) // length, left)
        n = min(count, left // per)
        placed.append(Placement(length, rank, n * per, start, used, per))
        groups[g] = [start, n, used + per * length, capacity]
        if groups[g][2] < capacity:
            insort(free, (capacity - groups[g][2], g))
        if n < count:
            groups.append([start + n, count - n, used, capacity])
            insort(free, (capacity - used, len(groups) - 1))
        return n * per

    for length in list(todo):
        left, rank = todo[length], 0
        while left:
            at = bisect_left(free, (length, -1))
            if at < len(free):
                _, g = free.pop(at)
            else:
                todo[length] = left
                capacity = opened(length, todo, capacities, overhead)
                n = max(1, left // (capacity // length))
                groups.append([bins, n, 0, capacity])
                bins += n
                g = len(groups) - 1
            done = fill(length, rank, left, g)
            left -= done
            rank += done
        del todo[length]
    return placed, [(b, n, used, min(c for c in capacities if c >= used)) for b, n, used, _ in groups]


def best_pack(histogram: dict[int, int], capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD):
    """pack() with each set of permitted capacities up to one of them that holds every length, and the plan of least cost."""
    longest = max(histogram, default=0)
    plans = [pack(histogram, [c for c in capacities if c <= top], overhead) for top in sorted(capacities) if top >= longest]
    plans += [pack(histogram, [top], overhead) for top in sorted(capacities) if top >= longest]
    whole = [(p, [(b, n, used, min(c for c in capacities if c >= used)) for b, n, used, _ in g]) for p, g in plans]
    return min(whole, key=lambda x: sum(n * (c + overhead) for _, n, _, c in x[1]))


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack_documents(docs: DataFrame, *, text: str = "text", key: str = "doc_id", length: Column | None = None, capacities: Sequence[int] = CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """Pack whole documents into bins: key, piece, start, length, bin_id, bin_capacity, bin_offset.

    A document's length is its number of words (or the given column, for instance a tokenizer's count). One longer than the largest
    capacity is cut into pieces of that capacity and a rest, numbered from 0; start is where a piece begins in its document. Pieces
    fill bins by best fit in decreasing order of length over the exact histogram of all lengths (its size is bounded by
    the largest capacity), and each bin ends with the smallest permitted capacity that holds its contents.
    Pieces of one length are numbered in parts, by a hash, whose number comes from the histogram, so a length
    that a third of all pieces have is spread. The plan, whose size depends on the capacities alone (pack()), goes to all tasks.

    Null and empty documents have no tokens: one row with length 0 and null bin_id, bin_capacity and bin_offset. Repeated rows and
    null keys are packed each for itself; pieces of equal length are alike, so which of them goes where is decided by their hash and key; other
    columns are not read, so their names clash with nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "packing")
    top = max(capacities)
    sized = docs.select(F.col(f"`{key}`").alias("k"), F.coalesce(n_words(f"`{text}`") if length is None else length, F.lit(0)).cast("long").alias("n"))
    cut = sized.select("k", "n", F.posexplode(F.sequence(F.lit(0).cast("long"), F.greatest((F.col("n") - 1) / top, F.lit(0)).cast("long"))).alias("piece", "i"))
    pieces = cut.select("k", "piece", (F.col("i") * top).alias("start"), F.least(F.col("n") - F.col("i") * top, F.lit(top)).cast("int").alias("length"))
    pieces = scratch.save(pieces, "pieces")
    # one row a length, at most the largest capacity
    histogram = {r["length"]: r["n"] for r in pieces.where("length > 0").groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed, groups = best_pack(histogram, capacities, overhead) if histogram else ([], [])
    size = sorted(groups)
    firsts = [g[0] for g in size]
    # a placement may reach over groups that were parted later
    rows = []
    for p in placed:
        at, done, n_bins = bisect_left(firsts, p.bin + 1) - 1, 0, -(-p.count // p.per)
        while done < n_bins:
            b, n, _, capacity = size[at]
            take = min(n_bins - done, b + n - (p.bin + done))
            rows.append((p.length << 48 | p.first + done * p.per, p.bin + done, p.offset, p.per, capacity))
            done += take
            at += 1
    plan = np.array(sorted(rows), np.int64).reshape(-1, 5)

    total = sum(histogram.values())
    salts = [max(1, -(-n * PART // total), -(-n // NUMBERED)) if (n := histogram.get(x, 0)) else 1 for x in range(1, top + 1)]
    filled = pieces.where("length > 0").withColumn("salt", F.pmod(F.xxhash64("k", "piece"), F.element_at(F.array(*map(F.lit, salts)), F.col("length"))).cast("int"))
    cells = scratch.save(filled.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")), "cells", small=True)
    earlier = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("length", "salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("k", "piece")
    ranked = filled.withColumn("r", F.row_number().over(order)).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("r") - 1)

    def place(batches):
        for b in batches:
            n, rank = (b.column(i).to_numpy().astype(np.int64) for i in (3, 4))
            at = np.searchsorted(plan[:, 0], n << 48 | rank, "right") - 1
            begin, first, offset, per, capacity = plan[at].T
            after = (n << 48 | rank) - begin
            made = (first + after // per, capacity.astype(np.int32), (offset + after % per * n).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(4)), *map(pa.array, made)], names=schema.names)

    schema = T.StructType([*pieces.schema, *T.StructType.fromDDL("bin_id long, bin_capacity int, bin_offset int")])
    whole = ranked.select("k", "piece", "start", "length", "rank").mapInArrow(place, schema)
    empty = pieces.where("length = 0").select("*", F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("bin_capacity"), F.lit(None).cast("int").alias("bin_offset"))
    return gathered(whole.unionByName(empty)).withColumnRenamed("k", key)
