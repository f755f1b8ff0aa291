"""Near-duplicate classes by min-max hashing of word shingles, with every link confirmed on full sets."""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, gathered, map_column, word_hashes, words
from .components import components

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Shingles that are hashed at once.
_CHUNK = 4096
#: Parts that a hot bucket is spread over where its members only look something up.
SALTS = 16


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles of a text as sorted 64-bit hashes.

    With fewer than n words the whole sequence is the one shingle; without words there is none.
    """
    h = word_hashes(words(text))
    if not len(h):
        return h
    size = min(n, len(h))
    with np.errstate(over="ignore"):
        s = h[: len(h) - size + 1].copy()
        for i in range(1, size):
            s *= _MIX[0]
            s ^= s >> np.uint64(29)
            s += h[i : len(h) - size + 1 + i]
        s *= _MIX[1]
        s ^= s >> np.uint64(32)
    return np.unique(s)


def plan(pct: int, miss: float = 1e-7) -> tuple[int, int]:
    """(bands, rows): so many that two sets at the threshold share no band with a probability of at most miss."""
    t = pct / 100
    rows = 5 if t >= 0.83 else 4 if t >= 0.7 else 3
    bands = math.ceil(math.log(miss) / math.log(1 - t**rows))
    return bands, rows


def permutations(count: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 1 << 63, count, np.uint64)


def min_max_signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum and the maximum of the set under each permutation x -> a x + b (mod 2^64): two values from one evaluation.

    Either agrees between two sets with a probability equal to their Jaccard similarity, and the two are nearly
    independent, so half the evaluations give a signature of the same length.
    """
    out = np.empty((len(a), 2), np.uint64)
    out[:, 0], out[:, 1] = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    with np.errstate(over="ignore"):
        for at in range(0, len(s), _CHUNK):
            x = s[at : at + _CHUNK]
            for i in range(len(a)):
                y = x * a[i] + b[i]
                out[i, 0] = min(out[i, 0], y.min())
                out[i, 1] = max(out[i, 1], y.max())
    return out.reshape(-1)



FIELDS = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType()))]


def sketch(docs: DataFrame, *, n: int, pct: int, text: str = "text", keep: list[str]) -> DataFrame:
    """n_shingles, set_key (128-bit hash of the set; null for an empty set) and band keys, beside the columns in keep."""
    bands, rows = plan(pct)
    a, b = permutations(math.ceil(bands * rows / 2))

    def one(t):
        s = shingles(t, n)
        if not len(s):
            return 0, None, None
        sig = min_max_signature(s, a, b)[: bands * rows].reshape(bands, rows)
        keys = [xxhash.xxh3_64_intdigest(row.tobytes(), seed=i) - (1 << 63) for i, row in enumerate(sig)]
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), keys

    def setup():
        def work(texts):
            out = [one(t) for t in texts]
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], []]

        return work

    return map_column(docs, text, setup, FIELDS, keep)


def full_sets(docs: DataFrame, *, n: int, text: str, key: str) -> DataFrame:
    """(key, set): the whole shingle set as little-endian 64-bit numbers."""

    def setup():
        return lambda texts: [[shingles(t, n).tobytes() for t in texts]]

    return map_column(docs, text, setup, [T.StructField("set", T.BinaryType())], [key])


def confirmed(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= pct * union on the full sets."""
    left = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    right = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    whole = pairs.join(left, "b").join(right, "a")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True)) if 100 * min(len(p), len(q)) >= pct * max(len(p), len(q)) else 0
                keep.append(100 * both >= pct * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return whole.select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def differences(family: DataFrame, sets: DataFrame) -> DataFrame:
    """(hub, id, size, c, marks): the shingles in which a member's set and its hub's differ."""
    left = sets.select("id", F.col("set").alias("own"))
    right = sets.select(F.col("id").alias("hub"), F.col("set").alias("hub_set"))
    whole = family.join(left, "id").join(right, "hub").select("hub", "id", "size", "c", "own", "hub_set")
    schema = T.StructType([*(whole.schema[k] for k in ("hub", "id", "size", "c")), T.StructField("marks", T.ArrayType(T.LongType()))])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            marks = [(np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True) ^ np.uint64(1 << 63)).view(np.int64) for x, y in zip(batch.column(4), batch.column(5), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(marks, pa.list_(pa.int64()))], names=schema.names)

    return whole.mapInArrow(run, schema)


def rare_marks(members: DataFrame, pct: int) -> DataFrame:
    """(hub, mark, id, size, c, place, all): of each member's differences, the rarest in the family, as many as any link to another member needs.

    Two members f, g are linked only if |f ^ g| <= u (|f| + |g|), u = (100 - pct) / (100 + pct). With D the difference of a set to
    the hub's, |Df & Dg| = (|Df| + |Dg| - |f ^ g|) / 2. If not both are linked to the hub, that is at least 1; and as |g| is at most
    100 |f| / pct, it is at least |Df| - S with S = u |f| (1 + 100 / pct). So in one order of the family's differences (how
    many members have it, then its value) the first S + 1 of each member must meet. Edits that a copy alone has come
    first and meet nothing; differences of one member only are counted, not kept. place is a mark's number in the member's order
    and all the size of D: at the first mark that two members share, they share no more than what follows on either side.
    """
    u, wide = (100 - pct) / (100 + pct), 1 + 100 / pct
    rows = members.select("hub", F.explode("marks").alias("mark"), "id", "size", "c", F.size("marks").alias("all"))
    often = members.select("hub", F.explode("marks").alias("mark")).groupBy("hub", "mark").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = rows.join(often, ["hub", "mark"])
    w = Window.partitionBy("hub", "id")
    place = F.col("all") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy("often", "mark"))
    return shared.withColumn("place", place).where(F.col("place") <= F.floor(u * wide * F.col("size") + 1e-9) + 1).select("hub", "mark", "id", "size", "c", "place", "all")


def classes(docs: DataFrame, *, n: int = 5, pct: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, kept, n_links.

    Texts are linked when 100 * intersection >= pct * union of their sets of n-word shingles; component_id is the smallest
    key that can be reached by links, kept says that a row is that one, and n_links counts the confirmed links
    between different sets that touch the row's set while components were found (links inside a known component are not searched).

    How: texts with one set form one class (exact copies never meet as pairs). Min-max signatures of class
    representatives are banded; in each bucket all members are compared with the bucket's smallest member, its hub. Members
    that stay in different components meet again only where they differ from the hub in the same shingles (rare_marks()
    says why no link is lost), again first with the smallest of such a group. Pairs are confirmed on full sets, so no
    false link is kept; a link at the threshold is missed with a probability below 1e-7. There is no cap on buckets or partners.

    Null and empty texts have no shingles and are linked with nothing. Keys are whole numbers (ValueError) and should be unique; rows that repeat a key are
    each returned. A null key takes part under no representative: it gets its class's component, or null if all keys of
    the class are null, and is kept only then. Other columns of docs are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dup")
    if not isinstance(docs.schema[key].dataType, T.IntegralType):
        raise ValueError(f"{key} is no whole number")
    docs = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = scratch.save(sketch(docs, n=n, pct=pct, keep=["id"]), "rows")
    filled = rows.where("set_key is not null")
    reps = scratch.save(filled.where("id is not null").groupBy("set_key").agg(F.min(F.struct("id", "n_shingles", "bands")).alias("r")).select("set_key", "r.*"), "reps", small=True)
    members = reps.select(F.explode("bands").alias("bucket"), "id", F.col("n_shingles").alias("size"))
    shared = members.groupBy("bucket").agg(F.min("id").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = scratch.save(members.join(shared, "bucket").select("bucket", "id", "size", "hub"), "buckets", small=True)
    near = [F.col("size_a") * 100 >= F.col("size_b") * pct, F.col("size_b") * 100 >= F.col("size_a") * pct]

    meant = buckets.select(F.col("id")).distinct()
    texts = docs.join(meant, "id", "left_semi")
    sets = scratch.save(full_sets(texts.dropDuplicates(["id"]), n=n, text="text", key="id"), "sets", small=True)

    hubs = buckets.where("id = hub").select(F.col("hub").alias("a"), "bucket", F.col("size").alias("size_a"))
    stars = buckets.where("id <> hub").select(F.col("id").alias("b"), "bucket", F.col("size").alias("size_b")).join(hubs, "bucket").where(near[0] & near[1]).select("a", "b").distinct()
    stars = scratch.save(stars, "stars", small=True)
    links = scratch.save(confirmed(stars, sets, pct), "links-star", small=True)
    found = components(links, scratch, "cc-star")
    found = scratch.save(found, "star-components", small=True)

    # what the hubs did not join: families (a hub and the members of its buckets) with members in different components
    placed = buckets.where("id <> hub").join(found.withColumnRenamed("node", "id"), "id", "left").select("bucket", "hub", "id", "size", F.coalesce("component", "id").alias("c"))
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi")
    # a bucket of very many members is spread over salts
    open_ = open_.select("bucket", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int"))
    family = scratch.save(placed.join(open_, ["bucket", "salt"], "left_semi").select("hub", "id", "size", "c").distinct(), "family", small=True)
    scratch.drop("buckets")
    members = scratch.save(differences(family, sets), "members", small=True)
    marks = scratch.save(rare_marks(members, pct), "marks", small=True)
    u = (100 - pct) / (100 + pct)
    more = None
    for step in ("near", "far"):
        now = marks if more is None else marks.drop("c").join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("c", F.coalesce("component", "id")).drop("component")
        groups = now.groupBy("hub", "mark").agg(F.min("id").alias("first"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("hub", "mark", "first")
        x = now.join(groups, ["hub", "mark"])
        left = x.select("hub", "mark", *(F.col(c).alias(f"{c}_b") for c in ("id", "size", "c", "place", "all")))
        # first each with the smallest of its group, then what is still apart
        right = (x.where("id = first") if step == "near" else x).select("hub", "mark", *(F.col(c).alias(f"{c}_a") for c in ("id", "size", "c", "place", "all")))
        need = (F.col("all_a") + F.col("all_b") - u * (F.col("size_a") + F.col("size_b"))) / 2 - 1e-9
        reach = F.least(F.col("all_a") - F.col("place_a"), F.col("all_b") - F.col("place_b")) + 1 >= need
        apart = (F.col("id_a") < F.col("id_b")) & (F.col("c_a") != F.col("c_b"))
        pairs = left.join(right, ["hub", "mark"]).where(apart & near[0] & near[1] & reach).select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
        if more is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        tried = scratch.save(pairs, f"pairs-{step}", small=True)
        new = scratch.save(confirmed(tried, sets, pct), f"links-{step}", small=True)
        more = new if more is None else more.unionByName(new)
        if step == "near":
            found = scratch.save(components(links.unionByName(new), scratch, "cc-near"), "near-components", small=True)
    scratch.drop("sets", "marks", "family", "members")
    every = scratch.save(links.unionByName(more), "links", small=True)
    found = scratch.save(components(every, scratch, "cc"), "components", small=True)

    degree = every.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    label = reps.select("set_key", "id").join(found.withColumnRenamed("node", "id"), "id", "left").join(degree, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = gathered(rows.select("id", "n_shingles", "set_key").join(label, "set_key", "left"))
    component = F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(key), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, component.isNull()).alias("kept"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def deduplicate(docs: DataFrame, *, n: int = 5, pct: int = 80, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Rows of docs that are kept by classes(): one document of each group, with the columns of docs, whatever their names.

    Keys should be unique: rows that repeat a kept key all stay, as they can't be told apart. Rows with a null key all stay, as do those
    with null or empty texts; an empty table stays empty.
    """
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = f"c{columns.index(key)}"
    gone = classes(docs, n=n, pct=pct, text=text, key=key).where(~F.col("kept") & F.col(key).isNotNull()).select(F.col(key).alias("gone")).distinct()
    return renamed.join(gone, F.col(at) == F.col("gone"), "left_anti").toDF(*columns)
