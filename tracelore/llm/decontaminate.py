"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, map_column, small_batches, word_hashes, words

_P = np.uint64(0x100000001B3)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Stand before the first token of pattern and text; no word has these hashes but by a 64-bit collision.
_NOTHING = np.array([0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407], np.uint64)
#: Bits of the filter of seeds that every task holds (2 MB), whatever the benchmark's size; a fuller one lets more through.
FILTER_BITS = 24
#: Parts that hot seeds and hot items are spread over.
SALTS = 16
#: Items that are tiled against a text in one row.
ITEMS_A_ROW = 256


def rolling(tokens: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of size tokens, by doubling: H(2k) is made from two H(k)."""
    if len(tokens) < size:
        return tokens[:0]
    with np.errstate(over="ignore"):
        out, have = None, 0
        run, length, factor = tokens, 1, _P
        rest = size
        while rest:
            if rest & 1:
                if out is None:
                    out, have = run, length
                else:
                    n = len(tokens) - have - length + 1
                    out, have = out[:n] * factor + run[have : have + n], have + length
            rest >>= 1
            if rest:
                n = len(tokens) - 2 * length + 1
                run, length, factor = run[:n] * factor + run[length : length + n], 2 * length, factor * factor
        return out[: len(tokens) - size + 1]


def mixed(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _MIX[0]
        x = (x ^ (x >> np.uint64(29))) * _MIX[1] + b
        x *= _MIX[0]
        return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def prefixes(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of tokens times powers, from which the Karp-Rabin hash of any run can be read, and the powers."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), _P)]), dtype=np.uint64)
        return np.concatenate([[np.uint64(0)], np.cumsum(tokens * powers[:-1], dtype=np.uint64)]), powers


def common_runs(pattern: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in pattern, place in text, length) of all common runs of `least` tokens or more that can't be lengthened on either side."""
    none = np.empty(0, np.int64)
    if min(len(pattern), len(text)) < least:
        return none, none, none
    hp, ht = rolling(pattern, least), rolling(text, least)
    # what stands before a run; nothing before the first of either equals anything
    before_p, before_t = np.r_[_NOTHING[0], pattern[: len(hp) - 1]], np.r_[_NOTHING[1], text[: len(ht) - 1]]
    at_t = np.flatnonzero(np.isin(ht, hp))
    # runs of the pattern by hash, and in it by what stands before them: a run that has the same before it belongs to a longer one
    order = np.lexsort((before_p, hp))
    hashes = hp[order]
    both = mixed(hashes, before_p[order])
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    last = np.r_[first[1:], len(both)]
    by_mix = np.argsort(both[first], kind="stable")
    want = mixed(ht[at_t], before_t[at_t])
    found = np.minimum(np.searchsorted(both[first][by_mix], want), len(first) - 1)
    same = both[first][by_mix][found] == want
    lo, hi = np.searchsorted(hashes, ht[at_t], "left"), np.searchsorted(hashes, ht[at_t], "right")
    skip_lo, skip_hi = np.where(same, first[by_mix][found], hi), np.where(same, last[by_mix][found], hi)
    i = order[np.concatenate([ragged(lo, skip_lo - lo), ragged(skip_hi, hi - skip_hi)])]
    j = np.concatenate([np.repeat(at_t, skip_lo - lo), np.repeat(at_t, hi - skip_hi)])
    # the longest common run from there on, by halving on the hashes of whole runs
    (sp, powers), (st, more) = prefixes(pattern), prefixes(text)
    powers = powers if len(powers) >= len(more) else more
    n = np.empty(len(i), np.int64)
    for at in range(0, len(i), 1 << 18):
        a, b = i[at : at + (1 << 18)], j[at : at + (1 << 18)]
        low, high = np.full(len(a), least), np.minimum(len(pattern) - a, len(text) - b)
        while (low < high).any():
            mid = (low + high + 1) // 2
            with np.errstate(over="ignore"):
                equal = (sp[a + mid] - sp[a]) * powers[b] == (st[b + mid] - st[b]) * powers[a]
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        n[at : at + (1 << 18)] = low
    return i, j, n


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length) of non-overlapping matches, always the longest that is left
    (ties: smallest place in pattern, then in text).

    Tokens equal under their 64-bit hash match. A common run that a tile has cut into is parted into what is left of it. Runs of which
    the pattern has nothing left are put aside in bulk, so repetitive texts cost no more than their number of common runs.
    """
    i, j, n = common_runs(pattern, text, least)
    order = np.lexsort((j, i, -n))
    i, j, n = i[order], j[order], n[order]
    p_marked, t_marked = np.zeros(len(pattern), bool), np.zeros(len(text), bool)
    found: list[tuple[int, int, int]] = []
    cut: list[tuple[int, int, int]] = []  # (-length, place, place) of what is left of runs
    at = idle = 0
    while at < len(n) or cut:
        if not cut or at < len(n) and (-n[at], i[at], j[at]) <= cut[0]:
            size, a, b = int(n[at]), int(i[at]), int(j[at])
            at += 1
        else:
            size, a, b = heapq.heappop(cut)
            size = -size
        taken = p_marked[a : a + size] | t_marked[b : b + size]
        if not taken.any():
            p_marked[a : a + size] = t_marked[b : b + size] = True
            found.append((a, b, size))
            idle = 0
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, taken, True].astype(np.int8)))
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= least:
                heapq.heappush(cut, (x - y, a + x, b + x))
        idle += 1
        if idle == 64:
            idle = 0
            # free runs of either side that are long enough, and of the runs to come those that meet some in both
            keep = np.ones(len(n) - at, bool)
            for marked, place in ((p_marked, i[at:]), (t_marked, j[at:])):
                total = np.r_[0, np.cumsum(marked)]
                free = np.r_[0, np.cumsum(total[least:] == total[:-least])]
                keep &= free[np.minimum(place + n[at:] - least + 1, len(free) - 1)] > free[np.minimum(place, len(free) - 1)]
            i, j, n, at = i[at:][keep], j[at:][keep], n[at:][keep], 0
    return found


def seed_keys(tokens: np.ndarray, size: int) -> np.ndarray:
    return mixed(rolling(tokens, size), np.uint64(size)).view(np.int64)


def bit_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three places in a filter of 2 ** bits bits."""
    x = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        return [(x * m) >> np.uint64(64 - bits) for m in (np.uint64(1), *_MIX)]


class Benchmark:
    """The items of a benchmark and their seeds as tables, and the filter of the seeds, the one thing that is sent to all tasks."""

    def __init__(self, benchmark: DataFrame, scratch: Scratch, *, item_text: str, item_key: str, seed: int, bits: int):
        self.seed, self.bits = seed, bits
        small_batches(benchmark.sparkSession)
        kind = benchmark.schema[item_key].dataType

        def read(batches):
            for b in batches:
                sets = [word_hashes(words(t)) for t in b.column(1).to_pylist()]
                keys = [np.unique(seed_keys(s, min(seed, len(s)))).tolist() if len(s) else [] for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array([min(seed, len(s)) for s in sets], pa.int32())], names=["item_id", "tokens", "seeds", "size"])

        schema = T.StructType([T.StructField("item_id", kind), T.StructField("tokens", T.BinaryType()), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType())])
        rows = benchmark.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{item_text}`").alias("t")).mapInArrow(read, schema).where("size > 0")
        self.items = scratch.save(rows.withColumn("item", F.monotonically_increasing_id()), "items")
        self.sizes = sorted(r["size"] for r in self.items.select("size").distinct().collect())  # at most `seed`

        def bits_of(batches):
            for b in batches:
                keys = b.column(0).flatten().to_numpy()
                at = np.unique(np.concatenate(bit_places(keys, bits))) if len(keys) else np.empty(0, np.uint64)
                word, first = np.unique(at >> np.uint64(6), return_index=True)
                ored = np.bitwise_or.reduceat(np.uint64(1) << (at & np.uint64(63)), first) if len(at) else at
                yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ored.view(np.int64))], names=["word", "ored"])

        # at most 2 ** (bits - 6) rows
        table = self.items.select("seeds").mapInArrow(bits_of, "word long, ored long").groupBy("word").agg(F.bit_or("ored").alias("ored")).toArrow()
        self.filter = np.zeros(max(1, 1 << bits >> 6), np.uint64)
        self.filter[table["word"].to_numpy()] = table["ored"].to_numpy().view(np.uint64)

    def sharing(self, docs: DataFrame, text: str) -> DataFrame:
        """docs with hits: the distinct keys of a text's runs that pass the filter. All that the benchmark has do, and few others."""
        sizes, held, bits = self.sizes, self.filter, self.bits

        def hits(text):
            tokens = word_hashes(words(text))
            out = []
            for size in sizes:
                keys = seed_keys(tokens, size)
                for at in range(3):
                    place = bit_places(keys, bits)[at]
                    keys = keys[(held[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)]
                out.append(keys)
            return np.unique(np.concatenate(out)).tolist() if out else []

        def setup():
            return lambda texts: [[hits(t) for t in texts]]

        return map_column(docs, text, setup, [T.StructField("hits", T.ArrayType(T.LongType()))], docs.columns)

    def tiled(self, rows: DataFrame, least: int) -> DataFrame:
        """(uid, item_id, item_words, covered, n_tiles, longest, tiles) for each of rows (uid, t, hits) and each item that shares a seed with it."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        salt = F.pmod(F.xxhash64("uid"), F.lit(SALTS)).cast("int").alias("salt")
        seeds = self.items.select(F.explode("seeds").alias("key"), "item").select("*", spread)
        met = rows.select("uid", salt, F.explode("hits").alias("key")).join(seeds, ["key", "salt"]).select("uid", "salt", "item").distinct()
        # a text with very many items has several rows
        many = met.groupBy("uid").agg(F.ceil(F.count(F.lit(1)) / ITEMS_A_ROW).alias("parts"))
        dealt = met.join(many, "uid").withColumn("part", F.pmod(F.xxhash64("item"), F.col("parts")))
        items = self.items.select("item", "item_id", "tokens", spread)
        held = dealt.join(items, ["item", "salt"]).groupBy("uid", "part").agg(F.collect_list(F.struct("item_id", "tokens")).alias("items"))
        kind = self.items.schema["item_id"].dataType
        names = ("item_words", "covered", "n_tiles", "longest")
        schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("item_id", kind), *(T.StructField(n, T.LongType()) for n in names), T.StructField("tiles", T.ArrayType(T.ArrayType(T.LongType())))])

        def run(batches):
            for b in batches:
                out = []
                for uid, text, held in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                    tokens = word_hashes(words(text))
                    for x in held:
                        item = np.frombuffer(x["tokens"], np.uint64)
                        # words that the item has not can't match: runs without any are passed over
                        got = tiles(item, np.where(np.isin(tokens, item), tokens, np.uint64(0)), min(least, len(item)))
                        out.append((uid, x["item_id"], len(item), sum(g[2] for g in got), len(got), max((g[2] for g in got), default=0), [list(g) for g in got]))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], to_arrow_type(f.dataType)) for c, f in enumerate(schema)], names=schema.names)

        return held.join(rows.select("uid", "t"), "uid").select("uid", "t", "items").mapInArrow(run, schema)


def overlaps(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", seed: int = 5, least: int = 3, bits: int = FILTER_BITS) -> DataFrame:
    """One row for each document and item that share a run of seed words: key, item_id, item_words, covered, n_tiles,
    longest, tiles ([place in item, place in document, length], in words).

    covered counts the item's words under greedy tiles of at least `least` words, so an item whose parts are reordered or
    interrupted is still covered. An item of fewer words than a seed is searched as one run. One pass over the documents, whatever the
    benchmark's size, finds those with a run that a filter of all seeds lets through; only these runs and documents are shuffled, to meet
    seeds and items by join. Of equally long tiles the first in the item, then in the document, is taken.
    Null or empty items and texts overlap with nothing; repeated rows of either side are each returned; null keys pass
    through; other columns are not read, so their names clash with nothing; empty tables give no rows.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    items = Benchmark(benchmark, scratch, item_text=item_text, item_key=item_key, seed=seed, bits=bits)
    rows = items.sharing(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")), "t").where(F.size("hits") > 0)
    rows = scratch.save(rows.withColumn("uid", F.monotonically_increasing_id()), "sharing")
    return rows.select("uid", "k").join(items.tiled(rows, least), "uid").drop("uid").withColumnRenamed("k", key)


def contaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.6, **options) -> DataFrame:
    """Rows of overlaps() whose covered share of the item is at least coverage, with that share."""
    return overlaps(docs, benchmark, **options).withColumn("coverage", F.col("covered") / F.col("item_words")).where(F.col("coverage") >= coverage)


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, coverage: float = 0.6, text: str = "text", item_text: str = "text", item_key: str = "item_id", seed: int = 5, least: int = 3, bits: int = FILTER_BITS) -> DataFrame:
    """Rows of docs, all columns whatever their names, without those that cover at least the share `coverage` of some item.

    As overlaps(); documents that share no seed pass through unshuffled. Null and empty texts stay, repeated rows stay or go together.
    """
    scratch = Scratch(docs.sparkSession, "decontaminate")
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    items = Benchmark(benchmark, scratch, item_text=item_text, item_key=item_key, seed=seed, bits=bits)
    looked = items.sharing(renamed, f"c{columns.index(text)}")
    rows = scratch.save(looked.where(F.size("hits") > 0).withColumn("uid", F.monotonically_increasing_id()), "sharing")
    found = items.tiled(rows.withColumn("t", F.col(f"c{columns.index(text)}")), least)
    gone = scratch.save(found.where(F.col("covered") >= coverage * F.col("item_words")).select("uid").distinct(), "gone", small=True)
    stay = rows.join(gone, "uid", "left_anti").select(*renamed.columns)
    return looked.where(F.size("hits") == 0).select(*renamed.columns).unionByName(stay).toDF(*columns)
