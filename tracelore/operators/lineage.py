"""What is recorded, under which origin, and what becomes of it when names, sections and modules change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Printed actions that are never recorded, whole and by their beginning.
SKIPPED = ("admit", "synth")
SKIPPED_PREFIXES = ("synth with cache", "fix", "cofix", "change_no_check", "exact_no_check", "native_cast_no_check", "vm_cast_no_check", "shelve")


def replayed(rows: DataFrame, recording: bool = True) -> DataFrame:
    """Rows of a loaded library that are learned: those under their canonical name, if recording is on."""
    return rows.where((F.col("canonical") == F.col("name")) & F.lit(recording))


def paired(before: DataFrame, after: DataFrame, key: str = "state_id") -> DataFrame:
    """Each state before a step with all states after it, in order, matched by identifier."""
    grouped = after.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "state"))).alias("after"))
    return before.join(grouped, key, "left").withColumn("after", F.coalesce(F.transform("after", lambda x: x["state"]), F.array().cast("array<string>")))


def recorded(rows: DataFrame, printed: str = "printed", ignored: str | None = None, scope_words: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose printed action is none of the skipped ones; what can't be printed (null) is kept, what an
    ignoring scope covers, by the column `ignored` or by how it begins (scope_words), is not."""
    text = F.lower(F.col(printed))
    skip: Column = text.isin(*SKIPPED)
    for p in (*SKIPPED_PREFIXES, *scope_words):
        skip = skip | text.startswith(p)
    kept = rows.where(~F.coalesce(skip, F.lit(False)))
    return kept if ignored is None else kept.where(~F.coalesce(F.col(ignored), F.lit(False)))


def reemitted(rows: DataFrame, ended: DataFrame, lemma: str = "lemma") -> DataFrame:
    """Original rows, and again with status QedTime those of lemmas that did not end aborted or admitted."""
    bad = ended.where(F.col("ending").isin("Abort", "Admitted")).select(lemma)
    return rows.withColumn("status", F.lit("Original")).unionByName(rows.join(bad, lemma, "left_anti").withColumn("status", F.lit("QedTime")))


def substituted(rows: DataFrame, renames: DataFrame, column: str, path: str, module: str) -> DataFrame:
    """Names replaced by a renaming (old, new); rows that change get the status Substituted, where they came from, and the module's path."""
    r = renames.select(F.col("old").alias(column), "new")
    out = rows.join(r, column, "left")
    return out.withColumns({"from_path": F.when(F.col("new").isNotNull(), F.col(path)), "status": F.when(F.col("new").isNotNull(), F.lit("Substituted")).otherwise(F.col("status")), path: F.when(F.col("new").isNotNull(), F.concat(F.lit(module + "."), F.element_at(F.split(path, r"\."), -1))).otherwise(F.col(path)), column: F.coalesce("new", column)}).drop("new")


def discharged(rows: DataFrame, sections: DataFrame, name: str = "name") -> DataFrame:
    """Rows after their section closes: name_obligation_N counts for its parent; a row whose constant the section does not know is
    dropped; of its hypotheses those the constant keeps stay. sections: (name, kept: array of hypotheses)."""
    parent = F.regexp_extract(F.col(name), r"^(.*?)(_obligation_[0-9]+)?$", 1)
    return rows.withColumn("__p", parent).join(sections.select(F.col("name").alias("__p"), "kept"), "__p").withColumn("hyps", F.filter("hyps", lambda h: F.array_contains("kept", h))).withColumns({"from_path": F.col("path"), "status": F.lit("Discharged")}).drop("__p", "kept")


def rebuilt(rows: DataFrame, locals_: DataFrame) -> DataFrame:
    """Local definitions that an action uses, put before it as let bindings in order of their names."""
    uses = locals_.select("step", F.concat(F.lit("let "), F.col("name"), F.lit(" := "), F.col("body"), F.lit(" in ")).alias("binding"), "name")
    lets = uses.groupBy("step").agg(F.array_sort(F.collect_list(F.struct("name", "binding"))).alias("l"))
    return rows.join(lets, "step", "left").withColumn("printed", F.concat(F.coalesce(F.array_join(F.transform("l", lambda x: x["binding"]), ""), F.lit("")), F.col("printed"))).drop("l")


def inlined(constants: DataFrame, known: DataFrame, hyps: DataFrame, opaque: str = "opaque") -> tuple[DataFrame, DataFrame]:
    """(constants as they are or as variables, hypotheses with one more for each constant that became a variable).

    Constants of opaque proofs that the environment does not know are side effects: they become variables of the context.
    """
    side = constants.where(F.col(opaque)).join(known, "const", "left_anti").select("step", "const", "type").distinct()
    marked = constants.join(side.select("step", "const", F.lit(True).alias("__v")), ["step", "const"], "left")
    return marked.withColumn("kind", F.when(F.col("__v"), "Var").otherwise("Const")).drop("__v"), hyps.unionByName(side.select("step", F.col("const").alias("hyp"), "type"))


def captured(definitions: DataFrame) -> DataFrame:
    """Section-local definitions, the last of each name."""
    return definitions.groupBy("section", "name").agg(F.max_by("body", "ord").alias("body"))


def notation_key(tries: DataFrame, aliases: DataFrame) -> DataFrame:
    """The least counter of each notation whose key is an alias that exists. tries: (notation, counter, key)."""
    return tries.join(aliases.select("key"), "key", "left_semi").groupBy("notation").agg(F.min_by("key", "counter").alias("key"), F.min("counter").alias("counter"))
