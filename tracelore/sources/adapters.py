"""The driver's tables as instances: (entry_id, action, ...) and features."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import features as ft
from ..functions import trees
from ..operators.model import dense_sequence


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, action, lemma): an order asks for a priority."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("entry_id"), F.col("o_orderpriority").alias("action"), F.col("o_custkey").alias("lemma"))


def order_tokens(spark: SparkSession, sf_dir: str, held: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(entry_id, name, tokens): the tokens of each line in an array, the line being a hypothesis. held: the orders (entry_id) of a bounded model, if only
    theirs are wanted; where: a condition on lineitem."""
    lines = table(spark, sf_dir, "lineitem")
    if where is not None:
        lines = lines.where(where)
    if held is not None:
        lines = lines.join(F.broadcast(held), lines["l_orderkey"] == held["entry_id"], "left_semi")
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    tokens = F.array(F.concat(F.lit("brand="), "p_brand"), F.concat(F.lit("flag="), "l_returnflag"), F.concat(F.lit("line="), "l_linestatus"))
    return lines.select(F.col("l_orderkey").alias("entry_id"), F.concat(F.lit("L"), F.col("l_linenumber").cast("string")).alias("name"), tokens.alias("tokens"))


def order_lines(spark: SparkSession, sf_dir: str, held: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    """(entry_id, name, feature): a row for each token. held, where: as in order_tokens()."""
    return order_tokens(spark, sf_dir, held, where).select("entry_id", "name", F.explode("tokens").alias("feature"))


def order_features(spark: SparkSession, sf_dir: str, held: DataFrame | None = None) -> DataFrame:
    """(entry_id, kind, feature): counted tokens of an order (goal) and its lines (hypotheses), prefix and count folded in. held: as in order_lines()."""
    orders = table(spark, sf_dir, "orders")
    if held is not None:
        orders = orders.join(F.broadcast(held), orders["o_orderkey"] == held["entry_id"], "left_semi")
    goal = orders.select(F.col("o_orderkey").alias("entry_id"), F.explode(F.array(F.concat(F.lit("status="), "o_orderstatus"), F.concat(F.lit("month="), F.month("o_orderdate").cast("string")))).alias("feature"))
    whole = goal.withColumn("side", F.lit(ft.GOAL)).unionByName(order_lines(spark, sf_dir, held).drop("name").withColumn("side", F.lit(ft.HYPOTHESIS)))
    counted = whole.groupBy("entry_id", "side", "feature").agg(F.count(F.lit(1)).alias("cnt"))
    return counted.select("entry_id", F.when(F.col("side") == ft.GOAL, "Struct").otherwise("Seman").alias("kind"), ft.folded(F.col("feature"), F.col("cnt"), F.col("side")).alias("feature"))


def event_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, seq, action, step, lemma, status, user_id, value): an event's type is to be predicted."""
    e = dense_sequence(table(spark, sf_dir, "events"), "event_id")
    return e.select(F.col("event_id").alias("entry_id"), "seq", F.col("event_type").alias("action"), F.floor((F.col("seq") - 1) / 4).alias("step"), F.floor((F.col("seq") - 1) / 40).alias("lemma"), F.when(F.col("value") >= 5, "Original").otherwise("Substituted").alias("status"), "user_id", "value")


def event_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, seq, tokens): user, hour, size of the value, and the key of its properties, those there are."""
    e = dense_sequence(table(spark, sf_dir, "events"), "event_id")
    tokens = F.array(F.concat(F.lit("user="), F.col("user_id").cast("string")), F.concat(F.lit("hour="), F.hour("ts").cast("string")), F.concat(F.lit("value="), F.floor(F.col("value") / 10).cast("string")), F.concat(F.lit("k="), F.get_json_object("props", "$.k")))
    return e.select(F.col("event_id").alias("entry_id"), "seq", F.array_compact(tokens).alias("tokens"))


def event_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, seq, feature): an event's distinct tokens."""
    return event_tokens(spark, sf_dir).select("entry_id", "seq", F.explode(F.array_distinct("tokens")).alias("feature"))


def event_complex_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, seq, feature): an event's distinct tokens and each with the one before it, by kind."""
    pairs = F.zip_with(F.slice("tokens", 2, F.size("tokens")), F.slice("tokens", 1, F.greatest(F.size("tokens") - 1, F.lit(0))), lambda a, b: F.concat(F.lit("Verti:"), a, F.lit("-"), b))
    every = F.concat(F.transform("tokens", lambda t: F.concat(F.lit("Seman:"), t)), pairs)
    return event_tokens(spark, sf_dir).select("entry_id", "seq", F.explode(F.array_distinct(every)).alias("feature"))


def turn_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, action, text) of conversation turns."""
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("role").alias("action"), "text", "conv_id", "turn")


def turn_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, feature): distinct words of a turn."""
    return turn_instances(spark, sf_dir).select("entry_id", F.explode(F.array_distinct(ft.words(F.col("text")))).alias("feature"))


def turn_complex_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, kind, feature): distinct words of a turn, and each word with the one before it."""
    w = ft.words(F.col("text"))
    pairs = F.zip_with(F.slice("w", 2, F.size("w")), F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat(F.lit("Verti:"), a, F.lit("-"), b))
    kinds = F.concat(F.transform("w", lambda x: F.concat(F.lit("Seman:"), x)), pairs)  # structures would be compared each with each to be made distinct
    return turn_instances(spark, sf_dir).select("entry_id", w.alias("w")).select("entry_id", F.explode(F.array_distinct(kinds)).alias("x")).select("entry_id", F.substring("x", 1, 5).alias("kind"), F.expr("substring(x, 7)").alias("feature"))


TREE = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("node_id", T.LongType()), T.StructField("parent_id", T.LongType()), T.StructField("ord", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("symbol", T.StringType())])
TREE_FEATURES = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("feature", T.StringType()), T.StructField("cnt", T.LongType())])
SCOPES = T.StructType([T.StructField(name, T.LongType()) for name in ("tree_id", "node_id", "last")])


def of_pages(spark: SparkSession, sf_dir: str, rows_of: Callable[[trees.Tree], Iterable[tuple]], schema: T.StructType, most: int = 20_000) -> DataFrame:
    """(page, what rows_of makes of its tree): pages are read one at a time and rows go out by about `most`, so a batch of pages never stands whole in Python."""
    kinds, names = [to_arrow_type(f.dataType) for f in schema], schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            for key, html in zip(b.column(0), b.column(1), strict=True):
                for r in rows_of(trees.from_html(html.as_py())):
                    rows.append((key.as_py(), *r))
                    if len(rows) >= most:
                        yield packed(rows)
                        rows = []
        if rows:
            yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for name, top in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):  # long pages must not add up
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(top))
    return table(spark, sf_dir, "pages").select("page_id", "html").mapInArrow(run, schema)


def page_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node tables of pages as terms."""
    return of_pages(spark, sf_dir, trees.nodes, TREE)


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted semantic, vertical and structural features of pages as terms."""
    return of_pages(spark, sf_dir, trees.complex_features, TREE_FEATURES)


def page_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tree_id, node_id, last): the preorder numbers each node of a page spans."""
    return of_pages(spark, sf_dir, trees.scopes, SCOPES)


def vector_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry_id, feature): the sign of each dimension."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.posexplode("embedding").alias("i", "x")).select("entry_id", F.concat(F.lit("d"), F.col("i").cast("string"), F.when(F.col("x") >= 0, "+").otherwise("-")).alias("feature"))


def vector_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("label").cast("string").alias("action"))


def library_file(path: str, extension: str = "eval") -> str:
    """The file beside a library's source: its logical path's last part, with another extension."""
    return f"{path.replace('.', '/')}.{extension}"


def seconds_of(encoded: int) -> float:
    """Time limits from 100,000 on stand for ten-millionths of a second."""
    return encoded / 1e7 if encoded >= 100_000 else float(encoded)
