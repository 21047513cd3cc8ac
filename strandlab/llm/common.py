"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Character classes fixed by the data contract.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where that is unset (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="strandlab-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/strandlab/{what}-{uuid.uuid4().hex}"


def stage(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*dfs: DataFrame) -> None:
    """Delete what ``stage`` wrote, through Hadoop's file system, once nothing reads it any more."""
    for df in dfs:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            if "/strandlab/" in folder.toString():
                folder.getFileSystem(conf).delete(folder, True)


def tasks_for(spark: SparkSession, rows: int, per_task: int = 16) -> int:
    """Tasks for ``rows`` rows that each stand for much work: a row each on few, ``per_task`` rows each on many."""
    return max(1, min(rows, max(4 * spark.sparkContext.defaultParallelism, rows // per_task)))


def free_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of plans that nothing refers to any more, instead of at some later collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once inside an expression, so that lambdas in ``body`` don't evaluate it again per element."""
    return F.transform(F.array(value), body)[0]


def fresh_key(*cols: Column) -> Column:
    """A key equal exactly where ``cols`` are; neither join side is partitioned by it yet.

    Both sides then get an exchange of their own, which lets adaptive execution split hot partitions.
    """
    return F.struct(*cols, F.lit(0).alias("fresh"))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def words_of(text: Column, gap: str = GAP) -> Column:
    """Maximal runs of characters outside ``gap``; null and blank texts give an empty array."""
    parts = F.split(F.coalesce(text, F.lit("")), gap)
    return F.filter(parts, lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")



def in_slices(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``most`` bytes of ``column``; a longer row is a slice of its own. Bounds a task's memory by its longest row."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < batch.num_rows:
        base = int(ends[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(ends, base + most, "right")))
        yield batch.slice(first, end - first)
        first = end
