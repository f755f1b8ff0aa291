"""Secrets by form, and by two character Markov models: random strings against ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# greedy runs of at least so many characters are exactly the long ones among all greedy runs
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A whole run of the characters that keys are written in.
RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
SIZE = len(ALPHABET) + 1
#: Stands around matches; in texts that have it, it is first replaced by another private character, so places stay.
MARK, OTHER = "\ue000", "\ue001"
#: Least mean log-likelihood ratio a character pair, in nats, and the least cut for the sum, whatever the strings say.
MEAN, TOTAL = 0.5, 8.0
#: Share of the documents' ordinary strings that may reach the cut, and share of random ones that must for their length to be asked about.
FALSE, POWER = 1e-4, 0.9
#: Lengths among which the least one is chosen.
LENGTHS = range(6, 25)
#: Pieces whose places are summed in one run; longer texts are summed by blocks of them.
BLOCK = 256
#: Weight of a character's own frequency against its frequency after the one before it.
PRIOR = 5.0


@dataclass
class Markov:
    """weights: log(P_random / P_identifier) of each pair of characters, at SIZE * first + second (0: not in the alphabet).

    A string of `least` characters or more counts as random from the sum `total` and the mean MEAN on.
    """

    weights: list[float]
    total: float = TOTAL
    least: int = 16

    def array(self) -> Column:
        return F.expr("array(" + ",".join(f"{w:.6f}D" for w in self.weights) + ")")

    def ratio(self, string: str, weights: str) -> Column:
        """Sum over the pairs of a string; weights names a column with the array."""
        codes = F.transform(F.split(string, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        return F.aggregate(
            codes,
            F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
            lambda a, c: F.struct(c.alias("last"), F.when(a["last"] < 0, a["sum"]).otherwise(a["sum"] + F.element_at(F.col(weights), a["last"] * SIZE + c + 1)).alias("sum")),
            lambda a: a["sum"],
        )


def parts(text: Column, pattern: str) -> Column:
    """What is outside and inside matches, in turn, beginning with the outside."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def placed(pieces: Column, kind: int) -> Column:
    """Spans (start, kind, end, value) of the pieces at odd places, in code points.

    Places are sums of lengths; they are summed in blocks of BLOCK pieces and then over blocks, as growing one list costs
    the square of its length.
    """

    def block(i: Column) -> Column:
        return F.aggregate(
            F.slice(pieces, i * BLOCK + 1, F.lit(BLOCK)),
            F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(SPANS).alias("spans")),
            lambda a, x: F.struct(
                (a["at"] + F.length(x)).alias("at"),
                (~a["inside"]).alias("inside"),
                F.when(a["inside"], F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), F.lit(kind).alias("kind"), (a["at"] + F.length(x)).alias("end"), x.alias("value"))))).otherwise(a["spans"]).alias("spans"),
            ),
            lambda a: F.struct(a["at"].alias("size"), a["spans"].alias("spans")),
        )

    moved = lambda spans, by: F.transform(spans, lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), block)
    # one list of lists, so that no block is copied again
    whole = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPANS}>").alias("parts")),
        lambda a, b: F.struct((a["at"] + b["size"]).alias("at"), F.concat(a["parts"], F.array(moved(b["spans"], a["at"]))).alias("parts")),
        lambda a: F.flatten(a["parts"]),
    )
    return F.when(F.size(pieces) > 1, whole).otherwise(F.array().cast(SPANS))


def with_base(docs: DataFrame, text: str) -> DataFrame:
    """Adds __t (the text scanned) and the spans by form: __assign, __access, __hex."""
    out = docs.withColumn("__t", F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER))
    # pieces are columns of their own: within a lambda they would be made again for each block
    out = out.withColumns({f"__p{k}": parts(F.col("__t"), form) for k, form in enumerate((ASSIGN, ACCESS, HEX))})
    out = out.withColumn("__assign", F.filter(placed(F.col("__p0"), 0), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 12))
    return out.withColumn("__access", placed(F.col("__p1"), 1)).withColumn("__hex", placed(F.col("__p2"), 2)).drop("__p0", "__p1", "__p2")


def random_sample(spark, n: int) -> DataFrame:
    """n random strings of 40 characters in each of the writings keys have: base64, letters and digits, letters, capitals and digits, hexadecimal.

    They are made from digests of numbers, so they are the same every time.
    """
    hexed = F.concat(*(F.sha2(F.concat(F.lit(f"{part}:"), F.col("id").cast("string")), 512) for part in "ab"))
    coded = F.base64(F.unhex(hexed))
    writings = {
        "base64": coded,
        "alphanumeric": F.regexp_replace(coded, "[^A-Za-z0-9]", ""),
        "letters": F.regexp_replace(coded, "[^A-Za-z]", ""),
        "capitals": F.regexp_replace(F.upper(coded), "[^A-Z0-9]", ""),
        "hex": hexed,
    }
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("writing"), F.substring(v, 1, 40).alias("s")) for k, v in writings.items())))
    return spark.range(n).select("id", each.alias("x")).select("id", "x.writing", "x.s")


def train(docs: DataFrame, *, text: str = "text", random_strings: int = 2000) -> Markov:
    """Count pairs of characters in random strings and in those of all documents, return the log ratios, and fit what a string must reach.

    Labelled random: random_strings strings of each of the writings of random_sample(), none of them from the documents or
    the rules by form. Labelled ordinary: words, names and numbers, that is the runs of 5 key characters or more that touch no
    span by form, in every row of docs, as often as there are rows that have them, and each once more in capitals. The cut
    `total` is what no more than the share FALSE of the ordinary strings (each counted once) reach, but TOTAL at least;
    `least` is the smallest of LENGTHS at which the share POWER of the random strings, cut to that length, reach it (of the
    writing that does so least). Documents have random strings too that no form names, and these must not raise the cut
    beyond themselves. If the models hold, an ordinary string reaches a ratio r with probability exp(-r) at most, so that any
    of n strings does with n * exp(-r) at most; where that is below FALSE, a string is not held against the cut.
    Only the pair counts, at most twice the square of the alphabet, counts of strings by whole ratios from the cut on, and a
    few sums reach the driver. Repeated rows count each; null and empty texts hold no words; an empty table leaves the
    random strings and a uniform ordinary model.
    """
    spark = docs.sparkSession
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), MARK, OTHER)
    for form in (ASSIGN, ACCESS, HEX):
        plain = F.regexp_replace(plain, form, " ")
    ordinary = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(RUN % 5), F.lit(0)))).alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    scratch = Scratch(spark, "secrets")
    ordinary = scratch.save(ordinary, "ordinary")
    made = random_sample(spark, random_strings)
    label = lambda df, s, y, n: df.select(s.alias("s"), F.lit(y).alias("y"), n.cast("long").alias("n"))
    strings = label(made, F.col("s"), 1, F.lit(1)).unionByName(label(ordinary, F.col("s"), 0, F.col("n"))).unionByName(label(ordinary, F.upper("s"), 0, F.lit(1)))
    codes = strings.select("y", "n", F.transform(F.split("s", ""), lambda c: F.instr(F.lit(ALPHABET), c)).alias("c"))
    pair = codes.select("y", "n", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda a, b: a * SIZE + b)).alias("p"))
    counts = [[0.0] * (SIZE * SIZE) for _ in range(2)]
    for r in pair.groupBy("y", "p").agg(F.sum("n").alias("n")).collect():
        counts[r["y"]][r["p"]] = float(r["n"])
    logs = []
    for c in counts:
        table = [c[i * SIZE : (i + 1) * SIZE] for i in range(SIZE)]
        all_ = sum(c)
        single = [(sum(row[j] for row in table) + 0.5) / (all_ + 0.5 * SIZE) for j in range(SIZE)]
        logs.append([math.log((x + PRIOR * p) / (sum(row) + PRIOR)) for row in table for x, p in zip(row, single, strict=True)])
    model = Markov([round(a - b, 6) for a, b in zip(logs[1], logs[0], strict=True)])
    # what the ordinary strings reach
    said = ordinary.withColumn("w", model.array()).select(F.length("s").alias("n"), model.ratio("s", "w").alias("r"))
    over = (F.col("r") >= TOTAL) & (F.col("r") >= MEAN * (F.col("n") - 1))
    tops = {r["top"]: r["n"] for r in said.groupBy(F.when(over, F.floor("r")).alias("top")).agg(F.count(F.lit(1)).alias("n")).collect()}
    scratch.drop("ordinary")
    n = sum(tops.values())
    ordinary_tops = [t for t in tops if t is not None and t < math.log(n / FALSE)]
    allowed = math.floor(FALSE * n)
    for top in sorted(ordinary_tops, reverse=True):
        allowed -= tops[top]
        if allowed < 0:
            model.total = top + 1.0
            break
    # and at which length random ones do
    sized = made.select("writing", F.explode(F.array(*map(F.lit, LENGTHS))).alias("n"), "s").select("writing", "n", F.expr("substring(s, 1, n)").alias("s")).withColumn("w", model.array())
    r = model.ratio("s", "w")
    power = sized.groupBy("n", "writing").agg(F.avg(((r >= model.total) & (r >= MEAN * (F.col("n") - 1))).cast("int")).alias("p")).groupBy("n").agg(F.min("p").alias("p")).where(F.col("p") >= POWER)
    model.least = power.agg(F.min("n")).first()[0] or max(LENGTHS)
    return model


def scan(docs: DataFrame, model: Markov, *, text: str = "text", keep: list[str]) -> DataFrame:
    """For each row: the columns in keep, base (spans by form) and spans (those and what the models find), each an array of
    (start, kind, end, value) by start and then kind, in code points with an exclusive end.

    The models are asked about every whole run of key characters of model.least or more, whether or not a form has it too: it
    becomes a span of kind markov if its log-likelihood ratio of random to ordinary reaches model.total in sum and MEAN a
    pair. Null and empty texts have no spans. Rows repeat as they are, columns are told apart by place and may have any
    names, and a kept column named base or spans gives way. An empty table gives no rows.
    """
    keep = [k for k in keep if k.lower() not in ("base", "spans")]
    at = [f"c{i}" for i in range(len(keep))]
    found = with_base(docs.select(*(F.col(f"`{k}`").alias(c) for k, c in zip(keep, at, strict=True)), F.col(f"`{text}`").alias("__text")), "__text")
    found = found.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex"))).withColumn("__w", model.array())
    # each distinct run of a text is weighed once, and places are looked for only where one is random
    runs = F.array_distinct(F.regexp_extract_all("__t", F.lit(RUN % model.least), F.lit(0)))
    found = found.withColumn("__random", F.filter(runs, lambda s: model.ratio(s, "__w") >= F.greatest(F.lit(model.total), MEAN * (F.length(s) - 1))))
    found = found.withColumn("__p3", F.when(F.size("__random") > 0, parts(F.col("__t"), RUN % model.least)).otherwise(F.array().cast("array<string>")))
    found = found.withColumn("__extra", F.filter(placed(F.col("__p3"), 3), lambda s: F.array_contains("__random", s["value"])))
    # before the kept columns have their names again, as a name in a lambda could mean one of them
    found = found.withColumn("__spans", F.array_sort(F.concat("__base", "__extra")))
    return found.select(*(F.col(c).alias(k) for k, c in zip(keep, at, strict=True)), F.col("__base").alias("base"), F.col("__spans").alias("spans"))


def named(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["kind"] + 1), x["start"], x["end"])), ",")


def count(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
