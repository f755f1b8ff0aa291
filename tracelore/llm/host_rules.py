"""Quality rules judged for whole hosts: failure rates shrunk by an empirical beta prior, verdicts joined back to documents."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_column, word_hashes

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: A host is rejected if the posterior mean of some rule's rate less REJECT_SD deviations is above MAX_RATE, and watched for a rule if
#: it is above the rate of all hosts by WATCH_SD deviations (one-sided 95 %).
MAX_RATE, REJECT_SD, WATCH_SD = 0.5, 1.0, 1.645
#: A host with more than the 1/HOT part of all rows is joined apart: there are fewer than HOT of them, so their verdicts can be sent everywhere.
HOT = 1000


def repeated_words(tokens: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text, the first time included."""
    if len(tokens) < 4:
        return 0
    h = word_hashes(tokens)
    with np.errstate(over="ignore"):
        w = h[:-2] * _MIX
        w = (w ^ (w >> np.uint64(29))) + h[1:-1]
        w *= _MIX
        w = (w ^ (w >> np.uint64(31))) + h[2:]
    _, inverse, counts = np.unique(w, return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    hit = np.zeros(len(tokens), bool)
    for k in range(3):
        hit[k : len(again) + k] |= again
    return int(hit.sum())


def measured(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; a null or empty one has zeros."""
    if not text:
        return (0,) * len(MEASURES)
    tokens = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(tokens), chars, sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)), repeated_words(tokens)


def measure(docs: DataFrame, *, text: str = "text", keep: list[str]) -> DataFrame:
    def setup():
        return lambda texts: [list(c) for c in zip(*map(measured, texts), strict=True)] if texts else [[] for _ in MEASURES]

    return map_column(docs, text, setup, [T.StructField(m, T.LongType()) for m in MEASURES], keep)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """A document's rule failures that count for its host."""
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "dup_lines": 10 * F.col("n_dup_lines") > 2 * F.col("n_lines"),
        "repeats": 10 * F.col("n_repeat_words") > 2 * F.col("n_words"),
        "word_length": (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 20 * F.col("n_words")),
    }


@dataclass
class BetaPrior:
    """mean and strength (alpha + beta) of the failure rate among hosts."""

    mean: float
    strength: float


def fit_prior(hosts: float, docs: float, fails: float, squares: float, inverse: float) -> BetaPrior:
    """Moments of a beta-binomial: squares is the sum of fails^2/docs by host, inverse that of 1/docs by host.

    One host, or none, gives the weak strength 2; rates that vary no more than chance give the largest, 1e6.
    """
    if not docs:
        return BetaPrior(0.5, 2.0)
    mean = fails / docs
    if hosts < 2:
        return BetaPrior(mean, 2.0)
    var = hosts * (squares - docs * mean * mean) / ((hosts - 1) * docs)
    excess = var - mean * (1 - mean) / hosts * inverse
    return BetaPrior(mean, min(1e6, max(1.0, (mean * (1 - mean) - var) / excess)) if excess > 0 else 1e6)


def verdicts(hosts: DataFrame, *, max_rate: float = MAX_RATE) -> DataFrame:
    """(host, n, host_rate, host_rejected, watched) from hosts (host, n, and k_<rule> for each of rules()).

    Each rule's rate is shrunk toward that of all hosts by a beta prior fitted to the hosts (moments). host_rate is the largest
    shrunk rate; watched lists the rules, in their order, whose rate is larger than that of all hosts beyond doubt. Without hosts there are no rows.
    """
    sums = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum(1 / F.col("n")).alias("i"), *(F.sum(f"k_{r}").alias(f"k_{r}") for r in rules()), *(F.sum(F.col(f"k_{r}") * F.col(f"k_{r}") / F.col("n")).alias(f"s_{r}") for r in rules())).first()
    rejected, rates, watched = [], [], []
    for r in rules():
        p = fit_prior(sums["h"], sums["n"] or 0, sums[f"k_{r}"] or 0, sums[f"s_{r}"] or 0, sums["i"] or 0)
        rate = (F.col(f"k_{r}") + p.mean * p.strength) / (F.col("n") + p.strength)
        sd = F.sqrt(rate * (1 - rate) / (F.col("n") + p.strength + 1))
        rejected.append(rate - REJECT_SD * sd > max_rate)
        watched.append(F.when(rate - WATCH_SD * sd > p.mean, F.lit(r)))
        rates.append(rate)
    return hosts.select("host", "n", F.greatest(*rates).alias("host_rate"), F.array_contains(F.array(*rejected), True).alias("host_rejected"), F.array_compact(F.array(*watched)).alias("watched"))


def judge(docs: DataFrame, *, text: str = "text", host: Column | None = None, keep: list[str] | None = None, max_rate: float = MAX_RATE) -> DataFrame:
    """Measures, base_failed, the host's verdict and kept, for each row of docs, beside the columns in keep.

    For each rule the failures of a host's documents are counted over the whole table and judged by verdicts(). Of a rejected
    host no document is kept (host_rejected). Of a host that is watched for a rule, documents that break this rule are not kept
    (host_watched). host defaults to the column source. Documents without a host (null) are in no host's
    counts and are judged by base_failed alone; their host_rate is null. Null and empty texts have zeros and fail the base rule. Repeated
    rows count each time; hosts with the same rates get the same verdict, and rates that vary no more than chance make no host
    stand out. Columns are told apart by place and may have any names; a kept column named as a result, in whatever
    case, gives way to it. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "host-rules")
    made = {*MEASURES, "base_failed", "host_rejected", "host_watched", "host_rate", "kept"}
    keep = [k for k in (keep if keep is not None else docs.columns) if k.lower() not in made]
    at = [f"c{i}" for i in range(len(keep))]
    named = docs.select(*(F.col(f"`{k}`").alias(c) for k, c in zip(keep, at, strict=True)), (F.col("source") if host is None else host).alias("host"), F.col(f"`{text}`").alias("text"))
    rows = measure(named, keep=[*at, "host"]).withColumn("base_failed", base_failed())
    rows = scratch.save(rows.withColumn("broken", F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in rules().items())))), "rows")
    hosts = scratch.save(rows.where("host is not null").groupBy("host").agg(F.count(F.lit(1)).alias("n"), *(F.sum(F.array_contains("broken", r).cast("long")).alias(f"k_{r}") for r in rules())), "hosts", small=True)
    total = hosts.agg(F.sum("n")).first()[0] or 0
    judged = verdicts(hosts, max_rate=max_rate)
    hot, cold = judged.where(F.col("n") * HOT > total).drop("n"), judged.where(F.col("n") * HOT <= total).drop("n")
    hosted = rows.where("host is not null")
    none = rows.where("host is null").select("*", F.lit(None).cast("double").alias("host_rate"), F.lit(False).alias("host_rejected"), F.array().cast("array<string>").alias("watched"))
    both = hosted.join(F.broadcast(hot), "host").unionByName(hosted.join(F.broadcast(hot.select("host")), "host", "left_anti").join(cold, "host")).unionByName(none)
    out = both.withColumn("host_watched", F.arrays_overlap("watched", "broken"))
    out = out.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected") & ~F.col("host_watched"))
    return out.select(*(F.col(c).alias(k) for k, c in zip(keep, at, strict=True)), *MEASURES, "base_failed", "host_rate", "host_rejected", "host_watched", "kept")
