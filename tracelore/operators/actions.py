"""Operators on actions as trees: node tables (tree_id, node_id, parent_id, ord, role, kind, symbol) and argument tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import action_hash

# How node classes are recorded; classes not named here are kept.
DECOMPOSED = ("Then", "Dispatch", "Extend", "Thens", "Thens3parts", "Select")
MODES = ("Decompose", "Keep", "Both", "Discard")
# Classes never recorded themselves; of the second only what is inside is.
UNRECORDED, TRANSPARENT = ("Id", "Fail"), ("Try", "Time", "ShowHyps", "Info", "Fun")
PRIORITY = {"global": 0, "section": 1, "local": 2, "other": 3}


def policy(spark: SparkSession, classes: list[str], overrides: dict[str, str] | None = None) -> DataFrame:
    """(kind, mode) of each class, a table small enough to send everywhere."""
    modes = {k: "Decompose" if k in DECOMPOSED else "Keep" for k in classes} | (overrides or {})
    for m in modes.values():
        if m not in MODES:
            raise ValueError(f"no mode {m}")
    return spark.createDataFrame(sorted(modes.items()), "kind string, mode string")


def annotated(nodes: DataFrame, modes: DataFrame) -> DataFrame:
    """Adds outer (the node itself is recorded) and descend (what is inside may be). Unlisted classes are kept."""
    out = nodes.join(F.broadcast(modes), "kind", "left").withColumn("mode", F.coalesce("mode", F.lit("Keep")))
    never = F.col("kind").isin(*UNRECORDED, *TRANSPARENT)
    outer = ~never & F.col("mode").isin("Keep", "Both")
    descend = (F.col("mode").isin("Decompose", "Both") | F.col("kind").isin(*TRANSPARENT)) & ~F.col("kind").isin(*UNRECORDED)
    return out.withColumns({"outer": outer, "descend": descend})


def split_compound(atoms: DataFrame) -> DataFrame:
    """An atomic action over a list becomes one action an element, in order; generalising goes from the last. A multiplicity
    ("n", "!" or "?" after the action) stays with each. atoms: (step, action, multiplicity, args)."""
    order = F.when(F.col("action") == "generalize", F.reverse("args")).otherwise(F.col("args"))
    return atoms.select("step", "action", "multiplicity", F.posexplode(order).alias("at", "arg")).withColumn("said", F.concat_ws(" ", F.concat("action", F.coalesce("multiplicity", F.lit(""))), "arg"))


def normalized(nodes: DataFrame, canonical: DataFrame) -> DataFrame:
    """Without source locations, and with each name under its canonical one. canonical: (symbol, full)."""
    return nodes.drop("loc").join(canonical, "symbol", "left").withColumn("symbol", F.coalesce("full", "symbol")).drop("full")


def skeleton(nodes: DataFrame) -> DataFrame:
    """Variables become X, constants one constant, terms holes: what is left is the action's shape."""
    return nodes.withColumn("symbol", F.when(F.col("kind") == "Var", F.lit("X")).when(F.col("kind").isin("Const", "Ind", "Construct"), F.lit("C")).when(F.col("kind") == "Term", F.lit("_")).otherwise(F.col("symbol")))


def preorder(nodes: DataFrame, render: Column | None = None) -> DataFrame:
    """(tree_id, text): the nodes of each tree in preorder, node_id being preorder, as kind:symbol."""
    said = F.concat_ws(":", "kind", "symbol") if render is None else render
    return nodes.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", said.alias("s")))), lambda x: x["s"]), " ").alias("text"))


def one_variable(arguments: DataFrame) -> DataFrame:
    """(tree_id, ord, arg, exact): the representative of each argument position: a global name before a section variable before a
    local one before anything else, then the first; exact says that nothing was left out. arguments: (tree_id, ord, place, arg, sort)."""
    rank = F.coalesce(*(F.when(F.col("sort") == s, F.lit(r)) for s, r in PRIORITY.items()), F.lit(3))
    return arguments.groupBy("tree_id", "ord").agg(F.min_by("arg", F.struct(rank, "place")).alias("arg"), (F.count(F.lit(1)) == 1).alias("exact"))


def stripped(arguments: DataFrame) -> DataFrame:
    """(tree_id, template, args): the action with a marker for each argument, and the arguments in order."""
    rows = F.array_sort(F.collect_list(F.struct("ord", "arg")))
    return arguments.groupBy("tree_id").agg(rows.alias("r")).select("tree_id", F.array_join(F.transform("r", lambda x: F.lit("?")), " ").alias("template"), F.transform("r", lambda x: x["arg"]).alias("args"))


def filled(templates: DataFrame, template: str = "template", args: str = "args") -> DataFrame:
    """Adds filled: markers replaced by arguments from left to right; null if there are too few or too many."""
    parts = F.split(F.col(template), r"\?")
    whole = F.array_join(F.flatten(F.zip_with(parts, F.col(args), lambda p, a: F.array(p, F.coalesce(a, F.lit(""))))), "")
    return templates.withColumn("filled", F.when(F.size(parts) == F.size(args) + 1, whole))


def substituted_hash(arguments: DataFrame, context: DataFrame, hole: str = "_hole") -> DataFrame:
    """(tree_id, text, hash): an action's arguments with those that its context has not replaced by a hole, and the identity of what is left.

    arguments: (tree_id, ord, arg), one a position; context: (tree_id, name). Actions that differ only in names the context has not are one class.
    """
    known = context.select("tree_id", F.col("name").alias("arg"), F.lit(True).alias("__known")).distinct()
    said = arguments.join(known, ["tree_id", "arg"], "left").withColumn("arg", F.when(F.col("__known"), F.col("arg")).otherwise(F.lit(hole)))
    rows = F.array_sort(F.collect_list(F.struct("ord", "arg")))
    return said.groupBy("tree_id").agg(F.array_join(F.transform(rows, lambda x: x["arg"]), " ").alias("text")).withColumn("hash", action_hash(F.col("text")))


def abstracted(occurrences: DataFrame) -> DataFrame:
    """Each occurrence of a free variable gets a name of its own, t0, t1, ... in order. occurrences: (tree_id, node_id, name)."""
    w = Window.partitionBy("tree_id").orderBy("node_id")
    return occurrences.withColumn("abstract", F.concat(F.lit("t"), (F.row_number().over(w) - 1).cast("string")))


def opaque_constants(nodes: DataFrame, constants: DataFrame) -> DataFrame:
    """The opaque constants a tree uses."""
    return nodes.where(F.col("kind") == "Const").join(constants.where("opaque").select("symbol"), "symbol", "left_semi").select("tree_id", "symbol").distinct()


def free_variables(variables: DataFrame, binders: DataFrame) -> DataFrame:
    """Occurrences outside every binder of their name, duplicates kept. variables: (tree_id, node_id, name); binders: (tree_id, name,
    first, last), the preorder numbers a binder scopes over."""
    v, b = variables.alias("v"), binders.alias("b")
    inside = [F.col("v.tree_id") == F.col("b.tree_id"), F.col("v.name") == F.col("b.name"), F.col("v.node_id") >= F.col("b.first"), F.col("v.node_id") <= F.col("b.last")]
    return v.join(b, inside, "left_anti")


def renamed(variables: DataFrame, binders: DataFrame, renames: DataFrame) -> DataFrame:
    """Free occurrences under their new name (old, new), bound ones as they are."""
    free = free_variables(variables, binders).join(renames.select(F.col("old").alias("name"), "new"), "name", "left").select("tree_id", "node_id", F.coalesce("new", "name").alias("__n"))
    return variables.join(free, ["tree_id", "node_id"], "left").withColumn("name", F.coalesce("__n", "name")).drop("__n")


def by_context(variables: DataFrame, hyps: DataFrame) -> DataFrame:
    """Each free variable becomes the hypothesis of its name, else the context's first, else _. hyps: (tree_id, ord, hyp)."""
    first = hyps.groupBy("tree_id").agg(F.min_by("hyp", "ord").alias("__first"))
    named = hyps.select("tree_id", F.col("hyp").alias("name"), F.lit(True).alias("__same")).distinct()
    return variables.join(named, ["tree_id", "name"], "left").join(first, "tree_id", "left").withColumn("name", F.when(F.col("__same"), F.col("name")).otherwise(F.coalesce("__first", F.lit("_")))).drop("__same", "__first")


def cooked(uses: DataFrame, existing: DataFrame) -> DataFrame:
    """Names of actions that no longer exist become local variables. uses: (tree_id, node_id, name); existing: (name)."""
    gone = uses.join(existing.select("name"), "name", "left_anti").select("tree_id", "node_id", F.lit("Var").alias("kind"))
    return uses.join(gone, ["tree_id", "node_id"], "left").withColumn("kind", F.coalesce("kind", F.lit("Call")))


def round_trip_failures(arguments: DataFrame, printed: Callable[[DataFrame], DataFrame] = lambda x: x) -> DataFrame:
    """Trees whose stripped form, filled again, is not what one argument a position gives; none is expected.

    printed: what printing and parsing make of (tree_id, template, args) in between.
    """
    one = one_variable(arguments)
    strip = filled(printed(stripped(one)))
    whole = one.groupBy("tree_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "arg"))), lambda x: x["arg"]), " ").alias("text"))
    return whole.join(strip.select("tree_id", F.col("filled").alias("text")), ["tree_id", "text"], "left_anti")


def mapped(nodes: DataFrame, hooks: dict[str, Column], column: str = "symbol") -> DataFrame:
    """A traversal of whole trees: the hook of a node's kind gives its new symbol; kinds without a hook stay as they are."""
    new: Column = F.col(column)
    for kind, hook in hooks.items():
        new = F.when(F.col("kind") == kind, hook).otherwise(new)
    return nodes.withColumn(column, new)


def unparsed(rows: DataFrame, printed: str = "printed", parsed: str = "parsed") -> DataFrame:
    """Rows whose printed form does not parse back to themselves; to be warned about."""
    return rows.where(~F.col(printed).eqNullSafe(F.col(parsed)))
