"""From states to sparse features, on linear text and on lists of tokens."""

from __future__ import annotations

from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GOAL, HYPOTHESIS = "GOAL-", "HYPS-"


def words(text: Column) -> Column:
    """The words of a text, in order; a null or blank text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def spine(tokens: Column) -> Column:
    """Atoms of a linear spine and each with the one before it, as atom-previous; multiplicity kept."""
    pairs = F.zip_with(F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("-"), b))
    return F.concat(tokens, F.when(F.size(tokens) > 1, pairs).otherwise(F.array().cast("array<string>")))


def feature_set(tokens: Column) -> Column:
    """Sorted and distinct."""
    return F.array_sort(F.array_distinct(tokens))


def tallied(tokens: Column) -> Column:
    """(feature, cnt) for each distinct token of an array: the sorted array is cut where a token differs from the one before."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))
        one = F.transform(F.array(starts), lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(s) + 1)), lambda i, j: F.struct(F.element_at(s, i).alias("feature"), (j - i).cast("long").alias("cnt"))))
        return F.when(F.size(s) > 0, F.element_at(one, 1))

    # the sorted array is bound to a name, so that it is made once and not for each of its elements
    return F.element_at(F.transform(F.array(F.sort_array(tokens)), runs), 1)


def counted(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """One row for each key and feature with its multiplicity.

    A row counts its own tokens; only rows whose key others have too are shuffled, so that their counts are added up.
    """
    tally = lambda rows: rows.select(*keys, F.explode(tallied(F.col(tokens))).alias("x")).select(*keys, "x.feature", "x.cnt")
    again = df.groupBy(*keys).count().where("count > 1").select(*(F.col(k).alias(f"__{k}") for k in keys))
    if again.isEmpty():
        return tally(df)
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys))
    summed = tally(df.join(again, same, "left_semi")).groupBy(*keys, "feature").agg(F.sum("cnt").alias("cnt"))
    return tally(df.join(again, same, "left_anti")).unionByName(summed)


def folded(feature: Column, count: Column, prefix: Column | str) -> Column:
    """Prefix and count become part of the feature, so that another count is another feature."""
    return F.concat(F.lit(prefix) if isinstance(prefix, str) else prefix, feature, F.lit("-"), count.cast("string"))


def one_line(text: Column) -> Column:
    """Line breaks outside strings become blanks; a break written inside one stays escaped."""
    return F.regexp_replace(F.regexp_replace(text, r"\r?\n[ \t]*", " "), r" +", " ")


def rendered(hypotheses: Column, goal: Column) -> Column:
    """name : type, name := body : type |- goal. hypotheses: array of (name, body, type), body null for an assumption."""
    shown = F.transform(hypotheses, lambda h: F.concat(h["name"], F.when(h["body"].isNotNull(), F.concat(F.lit(" := "), h["body"])).otherwise(F.lit("")), F.lit(" : "), h["type"]))
    return F.concat(F.array_join(shown, ", "), F.lit(" |- "), goal)


def sexpr(hypotheses: Column, goal: Column) -> Column:
    """(State (Goal g) (Hypotheses (name type body?) ...))"""
    shown = F.transform(hypotheses, lambda h: F.concat(F.lit("("), F.concat_ws(" ", h["name"], h["type"], h["body"]), F.lit(")")))
    return F.concat(F.lit("(State (Goal "), goal, F.lit(") (Hypotheses ("), F.array_join(shown, " "), F.lit(")))"))


def map_hypotheses(hypotheses: Column, on_type, on_body) -> Column:
    """on_type on each type and on_body on each body there is; the order stays."""
    return F.transform(hypotheses, lambda h: F.struct(h["name"].alias("name"), F.when(h["body"].isNotNull(), on_body(h["body"])).alias("body"), on_type(h["type"]).alias("type")))


def idf(n: Column, df: Column) -> Column:
    """ln((1 + N) / (1 + df)); a feature that was never seen has df 0."""
    return F.log((F.lit(1.0) + n) / (F.lit(1.0) + F.coalesce(df, F.lit(0))))


def idf_of(n: int, df: np.ndarray) -> np.ndarray:
    """idf() of an array."""
    return np.log((1.0 + n) / (1.0 + df))
