"""Splittable scans of FASTQ and FASTA files: tasks take byte ranges and own the records whose first line starts inside.

A FASTA record starts at a line with '>'. A FASTQ range has to find its phase, since a quality line may begin with '@' too: a
header is a line with '@' whose second next begins with '+'. Behind a quality line comes a header, and the line after that is a
sequence, which never begins with '+'; so the test is never met by another line. Records are numbered by the counts of the ranges
before theirs, which takes a scan of its own where a file has several ranges. Compressed files can't be split and are one range.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPLIT, BATCH = 32 << 20, 16_384
#: Stores that tasks can read byte ranges of.
SCHEMES = ("file", "hdfs", "s3", "s3a", "gs")


def open_file(path: str) -> io.BufferedReader | gzip.GzipFile:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    uri = f"file:///{rest.lstrip('/')}" if scheme == "file" else path.replace("s3a:", "s3:", 1)
    store, name = fs.FileSystem.from_uri(uri)
    raw = io.BufferedReader(store.open_input_file(name), 1 << 20)
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _lines(f: io.BufferedReader, start: int) -> Iterator[tuple[int, str]]:
    """(offset, line) of the lines that start at ``start`` or later."""
    at = start
    if start:
        f.seek(start - 1)
        at += len(f.readline()) - 1
    for line in f:
        yield at, line.rstrip(b"\r\n").decode()
        at += len(line)


def fastq_records(f: io.BufferedReader, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, qualities) of the records that start in [start, end); lines left over at the end make no record."""
    lines = _lines(f, start)
    held: list[tuple[int, str]] = []
    while True:
        while len(held) < 4 and (line := next(lines, None)) is not None:
            held.append(line)
        if not held or held[0][0] >= end:
            return
        if len(held) > 2 and held[0][1].startswith("@") and held[2][1].startswith("+"):
            if len(held) < 4:
                return
            yield held[0][1][1:], held[1][1].upper(), held[3][1]
            held = []
        else:
            held.pop(0)


def fasta_records(f: io.BufferedReader, start: int, end: int) -> Iterator[tuple[str, str, str]]:
    """(header, sequence, '') of the records that start in [start, end); sequences may go over several lines."""
    header, parts = None, []
    for at, line in _lines(f, start):
        if line.startswith(">"):
            if header is not None:
                yield header, "".join(parts).upper(), ""
            header, parts = None, []
            if at >= end:
                return
            header = line[1:]
        elif header is not None:
            parts.append(line)
    if header is not None:
        yield header, "".join(parts).upper(), ""


def byte_ranges(spark: SparkSession, path: str, glob: str, split: int = SPLIT) -> DataFrame:
    """(path, start, end): the files at ``path`` in ranges of ``split`` bytes; only their names and lengths are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "length").where("length > 0")
    step = F.when(F.col("path").endswith(".gz"), F.col("length")).otherwise(F.lit(split)).cast("long")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start")
    whole = F.col("path").endswith(".gz")
    return files.select("path", "length", start).select("path", "start", F.when(whole, F.lit(2**62)).otherwise(F.least(F.col("start") + split, F.col("length"))).alias("end"))


def scan(spark: SparkSession, path: str, glob: str, kind: str, split: int = SPLIT) -> DataFrame:
    """(path, read_ord, name, seq, qual) of the ``kind`` (fastq or fasta) files at ``path``; read_ord counts from 0 within a file."""
    records = {"fastq": fastq_records, "fasta": fasta_records}[kind]
    ranges = byte_ranges(spark, path, glob, split)
    sizes = ranges.groupBy("path").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n"), F.max("n")).first()
    # by number, since adaptive execution would run rows so narrow in one task
    ranges = ranges.repartition(max(1, min(sizes[0] or 1, 1 << 16)))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                with open_file(r.path) as f:
                    yield pd.DataFrame({"path": [r.path], "start": [r.start], "end": [r.end], "n": [sum(1 for _ in records(f, r.start, r.end))]})

    if (sizes[1] or 0) > 1:
        before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        counted = ranges.mapInPandas(count, "path string, start long, end long, n long")
        ranges = counted.select("path", "start", "end", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).repartition(max(1, min(sizes[0], 1 << 16)))
    else:
        ranges = ranges.withColumn("base", F.lit(0).cast("long"))

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                with open_file(r.path) as f:
                    rows = []
                    for k, (name, seq, qual) in enumerate(records(f, r.start, r.end)):
                        rows.append((r.path, r.base + k, name, seq, qual))
                        if len(rows) == BATCH:
                            yield pd.DataFrame(rows, columns=["path", "read_ord", "name", "seq", "qual"])
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows, columns=["path", "read_ord", "name", "seq", "qual"])

    return ranges.mapInPandas(read, "path string, read_ord long, name string, seq string, qual string")
