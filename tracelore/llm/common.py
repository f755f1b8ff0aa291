"""What the operators share: word rules, Arrow mapping of a text column, and tables in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Maps A-Z to a-z in UTF-8 bytes and leaves every other byte alone.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A word for Spark's regular expressions; bytes.split() parts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts handled at once, so that Python holds few copies of a large Arrow batch.
STEP = 128

_own_roots: dict[str, str] = {}


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text, in UTF-8; a null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(ASCII_LOWER).split()


def word_hashes(tokens: Sequence[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))


def fold_of(column: str = "doc_id", folds: int = 5) -> Column:
    """The crc32 of an id's decimal text, modulo the number of folds; a null id has fold 0 of an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python, by bytes and rows: long texts must not add up to gigabytes."""
    for name, most in (("maxRecordsPerBatch", 2000), ("maxBytesPerBatch", 8 << 20)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def map_column(df: DataFrame, column: str, setup: Callable[[], Callable], fields: list[T.StructField], keep: Sequence[str]) -> DataFrame:
    """Rows of df with the columns in keep and new fields made from one column.

    setup() runs once in each task and returns a function from a list of values to one list for each field. A kept column
    that has the name of a new field, in whatever case, is left out, so that the operator's own result stands.
    """
    small_batches(df.sparkSession)
    made = {f.name.lower() for f in fields}
    keep = [k for k in keep if k.lower() not in made]
    schema = T.StructType([df.schema[k] for k in keep] + fields)
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = schema.names
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                out = work(part.column(n).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(n)), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=names)

    # by place, as a kept column may have any name
    return df.select(*(F.col(f"`{k}`").alias(f"c{i}") for i, k in enumerate(keep)), F.col(f"`{column}`").alias("value")).mapInArrow(run, schema)


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one for this application, but only if all runs in one
    process: on a cluster, executors and driver would not see each other's files (ValueError)."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    return _own_roots.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tracelore-"))


def own_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables in the shared folder."""
    return f"{shared_root(spark)}/tracelore/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Delete this application's tables; for when no result that reads them is in use any more."""
    delete(spark, own_folder(spark))


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder in whatever store holds it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def gathered(df: DataFrame) -> DataFrame:
    """df in fewer partitions, without a shuffle: an eighth of the shuffle partitions, but four for each core at least.

    For what is small after joins and aggregations over many partitions, so that it is not written as very many small files.
    """
    spark = df.sparkSession
    return df.coalesce(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


class Scratch:
    """Intermediate tables of one call, as Parquet in the shared folder, so that lost executors cost no more than a reread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str, small: bool = False, rows_per_file: int = 0) -> DataFrame:
        """Write a table and read it again; small: gathered() first; rows_per_file: for rows of megabytes."""
        (gathered(df) if small else df).write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            delete(self.spark, f"{self.path}/{name}")


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of all texts; sizes partitions and blocks, never drops anything."""
    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"])
