"""FASTQ and FASTA files as DataFrames and back. One file is one sample; files are read in byte ranges (``ranges``).

Files in stores that tasks can't read ranges of are read whole, one by one, by Spark's text source; gzip is decoded either way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.sources import ranges


def sample_of(path: Column, cfg: Config = DEFAULT) -> Column:
    """The file's base name up to '_<suffix>', or up to its extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, rf"(_{cfg.input_suffix}.*|\.(fastq|fq|fasta|fa)(\.gz)?$)", "")


def _texts(spark: SparkSession, path: str, glob: str, cfg: Config) -> DataFrame:
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(sample_of(F.col("_metadata.file_path"), cfg).alias("sample_id"), F.col("_metadata.file_path").alias("file"), F.replace("value", F.lit("\r"), F.lit("")).alias("value"))


def splittable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read byte ranges of ``path``; one without a scheme is in Hadoop's default store."""
    scheme = path.partition("://")[0] if "://" in path else spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").partition(":")[0]
    return scheme in ranges.SCHEMES


def read_fastq(spark: SparkSession, path: str, glob: str = "*.{fastq,fq,fastq.gz,fq.gz}", cfg: Config = DEFAULT, split: int = ranges.SPLIT) -> DataFrame:
    """(sample_id, read_id, read_ord, seq, qual); sequences in upper case."""
    if not splittable(spark, path):
        return _whole_fastq(spark, path, glob, cfg)
    rows = ranges.scan(spark, path, glob, "fastq", split)
    return rows.select(sample_of(F.col("path"), cfg).alias("sample_id"), F.col("name").alias("read_id"), "read_ord", "seq", "qual")


def read_fasta(spark: SparkSession, path: str, glob: str = "*.{fasta,fa,fasta.gz,fa.gz}", cfg: Config = DEFAULT, split: int = ranges.SPLIT) -> DataFrame:
    """(sample_id, header, read_ord, seq); sequences may go over several lines."""
    if not splittable(spark, path):
        return _whole_fasta(spark, path, glob, cfg)
    rows = ranges.scan(spark, path, glob, "fasta", split)
    return rows.select(sample_of(F.col("path"), cfg).alias("sample_id"), F.col("name").alias("header"), "read_ord", "seq")


def _whole_fastq(spark: SparkSession, path: str, glob: str, cfg: Config) -> DataFrame:
    lines = _texts(spark, path, glob, cfg).withColumn("lines", F.split(F.rtrim("value"), "\n"))
    lines = lines.where(F.length(F.trim("value")) > 0)
    record = F.explode(F.sequence(F.lit(0), (F.size("lines") / 4).cast("int") - 1))
    rows = lines.where(F.size("lines") >= 4).select("sample_id", "lines", record.alias("i"))
    line = lambda k: F.get("lines", F.col("i") * 4 + k)
    return rows.select("sample_id", F.substr(line(0), F.lit(2)).alias("read_id"), F.col("i").cast("long").alias("read_ord"), F.upper(line(1)).alias("seq"), line(3).alias("qual"))


def _whole_fasta(spark: SparkSession, path: str, glob: str, cfg: Config) -> DataFrame:
    parts = F.filter(F.split(F.concat(F.lit("\n"), "value"), "\n>"), lambda x: F.length(F.trim(x)) > 0)
    rows = _texts(spark, path, glob, cfg).select("sample_id", F.posexplode(parts).alias("i", "record"))
    seq = F.replace(F.regexp_replace("record", r"^[^\n]*\n?", ""), F.lit("\n"), F.lit(""))
    return rows.select("sample_id", F.substring_index("record", "\n", 1).alias("header"), F.col("i").cast("long").alias("read_ord"), F.upper(seq).alias("seq"))


def write_fastq(reads: DataFrame, path: str) -> None:
    """One folder per sample, records in read order."""
    rows = reads.repartition("sample_id").sortWithinPartitions("sample_id", "read_ord")
    rows.select("sample_id", F.concat(F.lit("@"), "read_id", F.lit("\n"), "seq", F.lit("\n+\n"), "qual").alias("value")).write.mode("overwrite").partitionBy("sample_id").text(path)


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq") -> None:
    rows.select(F.concat(F.lit(">"), name, F.lit("\n"), seq)).write.mode("overwrite").text(path)


def invalid_reads(reads: DataFrame) -> DataFrame:
    """(sample_id, stage, message): reads whose sequence and quality differ in length, or with qualities out of range."""
    odd = F.length("seq") != F.length("qual")
    wild = F.col("qual").rlike(r"[^\x21-\x7E]")
    return reads.where(odd | wild).select("sample_id", F.lit("input").alias("stage"), F.concat(F.lit("bad read "), "read_id").alias("message"))


def pending(samples: DataFrame, done: DataFrame) -> DataFrame:
    """Samples without a result yet: what a resumed run still has to do."""
    return samples.join(done.select("sample_id").distinct(), "sample_id", "left_anti")
