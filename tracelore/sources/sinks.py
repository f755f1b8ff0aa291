"""Where results are written."""

from __future__ import annotations

import itertools
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated with a header; missing cells are empty."""
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def replace(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def shown(ranking: DataFrame, score: str = "score", action: str = "action") -> DataFrame:
    """Rankings as they are printed: the score with four digits, then the action."""
    return ranking.withColumn("line", F.format_string("%.4f %s", score, action))


def tables(spark: SparkSession, name: str) -> Callable[[DataFrame], DataFrame]:
    """A function that writes a frame as Parquet and reads it again, so that its lineage ends and lost executors cost a reread.

    The tables stand in spark.checkpoint.dir; where that is unset in a temporary folder, but only if all runs in one process (ValueError).
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tracelore-")
    path = f"{folder.rstrip('/')}/tracelore/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    count = itertools.count()

    def kept(df: DataFrame) -> DataFrame:
        own = f"{path}/{next(count)}"
        df.write.parquet(own)
        return spark.read.schema(df.schema).parquet(own)

    return kept
