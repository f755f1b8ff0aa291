"""Toxicity by a weighted lexicon that is matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_column

#: Characters that look like a Latin letter, and the letter.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ɡ": "g",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o",
}
#: Digits that stand for a letter, and signs that do so before a letter or digit.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
SIGNS = {"@": "a", "$": "s", "!": "i"}
_SIGN = re.compile(r"[@$!](?=\w)")
#: Fullwidth letters, made from the rule of their block.
WIDE = {chr(0xFF41 + i): chr(97 + i) for i in range(26)}
FOLD = str.maketrans(LOOKALIKES | LEET | WIDE | {c: "" for c in "\u200b\u200c\u200d\u00ad\u2060"})

#: Words that count before anything is learned; labels may outweigh them.
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "pathetic", "disgusting", "worthless", "imbecile", "dumbass", "bastard", "asshole", "retard", "vermin", "dummkopf", "idiota", "imbécil", "estúpido", "imbécile", "connard", "salaud", "abschaum", "arschloch")
#: Within these, a term does not count.
EXCEPTIONS = ("idiot proof", "idiot-proof", "stupid simple", "trash can", "trash bin", "sore loser rule", "clown fish", "class clown", "pathetic fallacy", "scum line", "the idiot by dostoevsky")

#: What a learned term may have to reach: the log ratio of its shares, and the log-likelihood ratio against chance. Which of
#: these pairs holds is decided by cross-validation within the training sample.
CUTS = tuple((weight, gain) for weight in (1.5, 2.5, 4.0) for gain in (8.0, 15.0, 25.0))
#: Parts of the sample, each scored by what was learned from the others.
PARTS = 3

LETTERS = re.compile(r"[^\W\d_]+")
SHORTEST = 3
#: Terms of either class whose counts a task gathers before it passes them on.
TERMS_HELD = 200_000


def fold(text: str | None) -> str:
    """Lower case, with look-alike letters, digits that stand for letters and invisible characters folded away."""
    text = (text or "").lower()
    if any(c in text for c in SIGNS):
        text = _SIGN.sub(lambda m: SIGNS[m.group()], text)
    return text.translate(FOLD)


@dataclass
class Lexicon:
    """terms: weight by term; one that ends in * matches at the start of a word, any other one a whole word.

    threshold: the normalised weight at which a text scores 0.5.
    """

    terms: dict[str, float]
    threshold: float = 0.5
    exceptions: tuple[str, ...] = field(default=EXCEPTIONS)

    def automaton(self) -> ahocorasick.Automaton:
        found: dict[str, list[tuple[str, float]]] = {}
        for term, weight in self.terms.items():
            found.setdefault(fold(term.rstrip("*")), []).append((term, weight))
        for phrase in self.exceptions:
            found.setdefault(fold(phrase), []).append(("", 0.0))
        a = ahocorasick.Automaton()
        for key, values in found.items():
            if key:
                a.add_word(key, (len(key), values))
        if len(a):
            a.make_automaton()
        return a

    def finder(self):
        """A function from text to its matches (start, term) that stand in no exception phrase."""
        a = self.automaton()

        def find(text: str | None) -> list[tuple[int, str]]:
            folded = fold(text)
            if not len(a) or not folded:
                return []
            hits, shields, n = [], [], len(folded)
            for end, (size, values) in a.iter(folded):
                start = end - size + 1
                if start and folded[start - 1].isalpha():
                    continue
                whole = end + 1 == n or not folded[end + 1].isalpha()
                for term, _ in values:
                    if not term:
                        if whole:
                            shields.append((start, end))
                    elif whole or term.endswith("*"):
                        hits.append((start, end, term))
            if not shields:
                return [(start, term) for start, _, term in hits]
            # of exception phrases that overlap, a hit is inside one if the furthest end of those that begin before it is not before its own
            shields.sort()
            furthest = list(accumulate((e for _, e in shields), max))
            out = []
            for start, end, term in hits:
                before = bisect_right(shields, start, key=lambda x: x[0])
                if not before or furthest[before - 1] < end:
                    out.append((start, term))
            return out

        return find

    def weighed(self, hits: list[tuple[int, str]]) -> tuple[float, int, list[str]]:
        """(sum of the weights, matches, distinct terms in order) of the matches that are of this lexicon; at one place in the text only the heaviest of nested
        terms counts."""
        best: dict[int, tuple[float, str]] = {}
        for start, term in hits:
            weight = self.terms.get(term)
            if weight is not None and (weight, term) > best.get(start, (-1.0, "")):
                best[start] = (weight, term)
        return sum(w for w, _ in best.values()), len(best), sorted({t for _, t in best.values()})

    def matcher(self):
        """A function from text to what weighed() gives for its matches."""
        find = self.finder()
        return lambda text: self.weighed(find(text))


def normalised(weight: float, chars: int) -> float:
    """Weight against length: a long text needs more, but its need grows with the logarithm alone."""
    return weight / math.log2(8 + chars / 100)


def beginnings(n: int) -> list[int]:
    """Lengths of the beginnings of a word of n letters: each from SHORTEST to 12, then each a quarter longer than the one before."""
    out, k = [], SHORTEST
    while k < n:
        out.append(k)
        k += max(1, k // 4) if k >= 12 else 1
    return out


def candidate_terms(text: str | None) -> set[str]:
    """Distinct words of the folded text, and their beginnings marked with *."""
    out: set[str] = set()
    for w in set(LETTERS.findall(fold(text))):
        if len(w) >= SHORTEST:
            out.add(w)
            out.update(w[:k] + "*" for k in beginnings(len(w)))
    return out


def shorter_terms(term: str) -> list[str]:
    """The beginnings that a term, a word or itself a beginning, has, without itself."""
    stem = term.rstrip("*")
    return [stem[:k] + "*" for k in beginnings(len(stem) + (not term.endswith("*")))]


def chosen(counts: dict[str, tuple[int, int]], n_pos: int, n_neg: int, least_weight: float, least_gain: float) -> dict[str, float]:
    """Terms whose share among toxic texts is larger beyond chance, with the log of the ratio of the shares."""

    def gain(pos: int, neg: int) -> float:
        rate = (pos + neg) / (n_pos + n_neg)
        return 2 * sum(k * math.log(k / (n * rate)) for k, n in ((pos, n_pos), (neg, n_neg)) if k)

    good = {}
    for term, (pos, neg) in counts.items():
        weight = math.log((pos + 0.5) / (n_pos + 1)) - math.log((neg + 0.5) / (n_neg + 1))
        if pos >= 3 and weight >= least_weight and gain(pos, neg) >= least_gain:
            good[term] = weight
    dropped = set()
    for term in good:  # of a word and its beginnings, the most specific that is as frequent
        dropped.update(x for x in shorter_terms(term) if x in good and counts[term][0] >= 0.9 * counts[x][0])
    covered: Counter[str] = Counter()
    for term, weight in good.items():  # a beginning whose toxic texts are mostly those of clearly sharper terms says nothing itself
        for x in shorter_terms(term):
            if x in good and weight >= good[x] + 1.5:
                covered[x] += counts[term][0]
    dropped |= {t for t, n in covered.items() if 2 * n >= counts[t][0]}
    good = {t: w for t, w in good.items() if t not in dropped}
    for term in SEED_TERMS:
        pos, neg = counts.get(term, (0, 0))
        if term not in good and neg <= 2 * pos:
            good[term] = 3.0
    return good


def passing(pos: Column, neg: Column, n_pos: int, n_neg: int, weight: float, gain: float) -> Column:
    """What chosen() asks of a term's weight and gain; a little wider, as chosen() looks again."""
    rate = (pos + neg) / (n_pos + n_neg)
    part = lambda k, n: F.when(k > 0, k * F.log(k / (n * rate))).otherwise(0.0)
    ratio = F.log((pos + 0.5) / (n_pos + 1)) - F.log((neg + 0.5) / (n_neg + 1))
    return (pos >= 3) & (ratio >= weight - 1e-6) & (2 * (part(pos, n_pos) + part(neg, n_neg)) >= gain - 1e-6)


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", train: Column | None = None, max_toxic: int = 4000, max_clean: int = 8000) -> Lexicon:
    """Learn weights, what a term must reach, and the threshold, all from labelled rows for which train holds.

    The classifier is fitted on a bounded sample: about max_toxic texts with label 1 and max_clean with label 0, drawn by a
    hash of the key from those rows. The sample has PARTS parts, by another hash of the key; each part is scored by the lexicons that the others give under each pair
    of CUTS, and the pair with the best F1 over all parts (the sample's classes weighed back to their shares; of equal ones the strictest) is the one
    the whole sample is learned with. Its cut between scores on parts not learned from is the threshold. Every word and beginning in the sample
    is weighed in the cluster, and those that pass reach the driver. A key with several labels counts as toxic if one of them says so; null keys and
    labels are left out; repeated rows of docs count each. Without labels of both classes the seed terms alone are returned.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    if train is not None:
        known = known.where(train)
    known = known.groupBy(F.col(key).alias("__k")).agg(F.max((F.col(label) == 1).cast("int")).alias("__y"))
    n = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    seeds_only = Lexicon({t: 3.0 for t in SEED_TERMS})
    if not n.get(1) or not n.get(0):
        return seeds_only
    share = F.when(F.col("__y") == 1, F.lit(max_toxic / n[1])).otherwise(F.lit(max_clean / n[0]))
    drawn = known.where(F.pmod(F.xxhash64("__k"), F.lit(1 << 20)) < share * (1 << 20))
    scratch = Scratch(spark, "toxicity")
    # about 12,000 keys of the drawn sample, whatever the input, so that texts need not be shuffled
    part = F.pmod(F.xxhash64("__k", F.lit("part")), F.lit(PARTS)).cast("int").alias("__p")
    sample = docs.select(F.col(key).alias("__k"), F.col(text).alias("__t")).join(F.broadcast(drawn), "__k").select("__t", "__y", part)
    # the sample is bounded; dealt anew, its texts are not all where a few input files were
    sample = scratch.save(sample.repartition(2 * spark.sparkContext.defaultParallelism), "sample")
    places = [(p, y) for p in range(PARTS) for y in (1, 0)]

    def count(batches):
        seen: dict[tuple[int, int], Counter[str]] = {at: Counter() for at in places}

        def told():
            terms = list({t for c in seen.values() for t in c})
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([seen[at][t] for t in terms], pa.int64()) for at in places)], names=["term", *(f"n{p}_{y}" for p, y in places)])

        for b in batches:
            for t, y, p in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                seen[p, y].update(candidate_terms(t))
                if sum(map(len, seen.values())) >= TERMS_HELD:
                    yield told()
                    for c in seen.values():
                        c.clear()
        yield told()

    sizes = {(r["__p"], r["__y"]): r["count"] for r in sample.groupBy("__p", "__y").count().collect()}
    size = lambda y, without=None: sum(k for (p, z), k in sizes.items() if z == y and p != without)
    if not size(1) or not size(0):
        return seeds_only
    columns = [f"n{p}_{y}" for p, y in places]
    totals = sample.mapInArrow(count, "term string, " + ", ".join(f"{c} long" for c in columns)).groupBy("term").agg(*(F.sum(c).alias(c) for c in columns))
    # terms that pass somewhere under the least strict cuts: in the whole sample or without one of its parts
    least = min(w for w, _ in CUTS), min(g for _, g in CUTS)
    told = lambda y, without=None: sum((F.col(f"n{p}_{y}") for p in range(PARTS) if p != without), F.lit(0))
    some = F.col("term").isin(list(SEED_TERMS))
    for without in (None, *range(PARTS)):
        if size(1, without) and size(0, without):
            some = some | passing(told(1, without), told(0, without), size(1, without), size(0, without), *least)
    counts = {r["term"]: {at: r[f"n{at[0]}_{at[1]}"] for at in places} for r in totals.where(some).collect()}

    def terms(cut: tuple[float, float], without: int | None = None) -> dict[str, float]:
        of = lambda c, y: sum(k for (p, z), k in c.items() if z == y and p != without)
        if not size(1, without) or not size(0, without):
            return seeds_only.terms
        return chosen({t: (of(c, 1), of(c, 0)) for t, c in counts.items()}, size(1, without), size(0, without), *cut)

    lexicons = {(cut, p): Lexicon(terms(cut, p)) for cut in CUTS for p in range(PARTS)}
    scored = weighed_apart(sample, lexicons).collect()
    worth = {y: n[y] / size(y) for y in (0, 1)}
    best = None
    for i, cut in reversed(list(enumerate(CUTS))):
        f1, threshold = best_threshold([(normalised(r["weights"][i], r["n"]), r["__y"]) for r in scored], worth)
        if best is None or f1 > best[0] + 1e-9:
            best = f1, threshold, cut
    scratch.drop("sample")
    return Lexicon(terms(best[2]), threshold=best[1])


def weighed_apart(sample: DataFrame, lexicons: dict[tuple[tuple[float, float], int], Lexicon]) -> DataFrame:
    """(__y, n, weights): each text's length, and its weight under each of CUTS by the lexicon learned without its part. A text is scanned once, for the
    terms of all of them."""

    def run(batches):
        finders: dict[int, object] = {}
        for b in batches:
            out = []
            for t, p in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if p not in finders:
                    finders[p] = Lexicon({term: 0.0 for cut in CUTS for term in lexicons[cut, p].terms}).finder()
                hits = finders[p](t)
                out.append([lexicons[cut, p].weighed(hits)[0] for cut in CUTS])
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([len(t or "") for t in b.column(0).to_pylist()], pa.int64()), pa.array(out, pa.list_(pa.float64()))], names=["__y", "n", "weights"])

    return sample.mapInArrow(run, "__y int, n long, weights array<double>")


def best_threshold(points: list[tuple[float, int]], worth: dict[int, float]) -> tuple[float, float]:
    """(F1, cut): the cut between values with the best F1, where a point of class y counts worth[y] times; of several the highest. Values are at least 0."""
    clean, toxic = Counter(x for x, y in points if not y), Counter(x for x, y in points if y)
    values = sorted({0.0, *clean, *toxic})
    every = worth[1] * sum(toxic.values())
    hit = wrong = 0.0
    best, cut = (-1.0, 0.0), 2 * values[-1] + 1.0
    for low, high in zip(reversed([0.0, *values[:-1]]), reversed(values), strict=True):
        hit += worth[1] * toxic[high]
        wrong += worth[0] * clean[high]
        f1 = 2 * hit / (hit + wrong + every) if every else 0.0
        if high > 0 and f1 > best[0] + 1e-12:
            best, cut = (f1, 0.0), (low + high) / 2
    return max(best[0], 0.0), max(cut, 1e-3)


FIELDS = [T.StructField("weight", T.DoubleType()), T.StructField("n_matches", T.LongType()), T.StructField("matched", T.ArrayType(T.StringType())), T.StructField("n_chars_read", T.LongType())]


def weigh(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", keep: list[str]) -> DataFrame:
    """The sum of the weights of a text's matches, their number, the terms, and the text's length, beside the columns in keep."""

    def setup():
        match = lexicon.matcher()

        def work(texts):
            out = [(*match(t), len(t or "")) for t in texts]
            return [list(c) for c in zip(*out, strict=True)] if out else [[], [], [], []]

        return work

    return map_column(docs, text, setup, FIELDS, keep)


def score(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score whole texts: toxic_score in [0, 1), 0.5 at the lexicon's threshold, and the matched terms.

    A null or empty text scores 0. Rows are neither dropped nor merged, repeated rows score alike, and other columns in keep
    pass through; a kept column named as one of the operator's own results, in whatever case, gives way to it. An empty table stays empty.
    """
    x = F.col("weight") / F.log2(F.lit(8.0) + F.col("n_chars_read") / 100)
    made = {"toxic_score", *(f.name for f in FIELDS)}
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in made]
    return weigh(docs, lexicon, text=text, keep=kept).withColumn("toxic_score", x / (x + lexicon.threshold))


def clean(docs: DataFrame, lexicon: Lexicon, *, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns as they are whatever their names, that score below `least`."""
    columns = docs.columns
    renamed = docs.toDF(*(f"c{i}" for i in range(len(columns))))
    at = f"c{columns.index(text)}"
    return score(renamed, lexicon, text=at).where(F.col("toxic_score") < least).select(*renamed.columns).toDF(*columns)
