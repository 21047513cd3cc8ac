"""Reads with planted truth, derived from the driver's ``orders``; the same rows in Spark and in DuckDB.

One order is one read. A sample is a customer (a few reads each) or a customer number modulo 8 (many reads each).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.functions import blocks

HEX, BASES, WIDTH = "0123456789abcdef", "ACGTACGTACGTACGT", 64
#: Runs laid over the template for the masking queries: (first column, bases).
RUNS = ((11, "AAAAAA"), (21, "ACACACACACACAC"), (41, "ACGACGACGACGACGACGACG"))


def _template(runs: bool) -> str:
    t = "".join(hashlib.md5(x).hexdigest() for x in (b"locus0", b"locus1")).translate(str.maketrans(HEX, BASES))
    for at, run in RUNS if runs else ():
        t = t[: at - 1] + run + t[at - 1 + len(run) :]
    return t


def _derived(runs: bool) -> Callable[[Column, Column, Column], Column]:
    """(aln_seq, aln_qual) of noise digits, quality digits and truth, a batch of reads at a time."""
    t = _template(runs)
    codes = lambda s: np.frombuffer(s.encode(), np.uint8)
    plain, swapped, of_o, of_p = (codes(t.translate(str.maketrans("ACGT", to))) for to in ("ACGT", "CATG", "GTAC", "TGCA"))
    o_site, p_site = (np.isin(np.arange(1, WIDTH + 1), at) for at in ((5, 20, 40), (10, 33)))

    def derive(n: pa.Array, q: pa.Array, truth: pa.Array) -> pa.Array:
        (x, cells), (y, _), state = blocks.block(n), blocks.block(q), blocks.block(truth)[0][:, :1]
        if not len(x):
            return pa.StructArray.from_arrays([pa.array([], pa.string())] * 2, names=["aln_seq", "aln_qual"])
        own = np.where((state == ord("O")) & o_site, of_o, np.where((state == ord("P")) & p_site, of_p, plain))
        base = np.where(x == ord("0"), blocks.GAP, np.where(x == ord("1"), swapped, own)).astype(np.uint8)
        digit = np.where(y > ord("9"), y - ord("a") + 10, y - ord("0"))
        qual = np.where(base == blocks.GAP, ord("!"), 38 + 2 * digit).astype(np.uint8)
        return pa.StructArray.from_arrays([blocks.strings(base, cells), blocks.strings(qual, cells)], names=["aln_seq", "aln_qual"])

    return F.arrow_udf(derive, "aln_seq string, aln_qual string")


def aligned(spark: SparkSession, sf_dir: str, samples: int | None = 8, runs: bool = False) -> DataFrame:
    """(sample_id, read_id, read_ord, truth, aln_seq, aln_qual): gaps have quality 0."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    part = lambda k: F.concat(*(F.md5(F.concat(F.coalesce(key, F.lit("")), F.lit(f":{k}{i}"))) for i in (0, 1)))
    sample = F.col("o_custkey") % samples if samples else F.col("o_custkey")
    o = o.select(sample.cast("string").alias("sample_id"), key.alias("read_id"), F.col("o_orderkey").alias("read_ord"), F.col("o_orderstatus").alias("truth"), _derived(runs)(part("n"), part("q"), F.col("o_orderstatus")).alias("x"))
    return o.select("sample_id", "read_id", "read_ord", "truth", "x.aln_seq", "x.aln_qual")


def bases(reads: DataFrame) -> DataFrame:
    """Long form: (sample_id, read_id, read_ord, truth, pos, base, q), positions from 1."""
    pairs = F.arrays_zip(F.split("aln_seq", "").alias("base"), F.split("aln_qual", "").alias("c"))
    long = reads.select("sample_id", "read_id", "read_ord", "truth", F.posexplode(pairs).alias("i", "x")).where("x.base != ''")
    return long.select("sample_id", "read_id", "read_ord", "truth", (F.col("i") + 1).alias("pos"), F.col("x.base").alias("base"), (F.ascii("x.c") - 33).alias("q"))


def sql(samples: int | None = 8, runs: bool = False) -> str:
    """DuckDB CTEs ``bases`` and ``reads`` with the rows of ``bases`` and ``aligned``."""
    t = f"concat(translate(md5('locus0'), '{HEX}', '{BASES}'), translate(md5('locus1'), '{HEX}', '{BASES}'))"
    for at, run in RUNS if runs else ():
        t = f"concat(left({t}, {at - 1}), '{run}', substr({t}, {at + len(run)}))"
    return f"""
raw AS (
  SELECT (o_custkey{f" % {samples}" if samples else ""})::VARCHAR AS sample_id, o_orderkey::VARCHAR AS read_id, o_orderkey AS read_ord, o_orderstatus AS truth,
    concat(md5(concat(o_orderkey::VARCHAR, ':n0')), md5(concat(o_orderkey::VARCHAR, ':n1'))) AS n,
    concat(md5(concat(o_orderkey::VARCHAR, ':q0')), md5(concat(o_orderkey::VARCHAR, ':q1'))) AS qn FROM orders),
tpl AS (SELECT {t} AS tt),
bases AS (
  SELECT sample_id, read_id, read_ord, truth, pos, base, CASE WHEN base = '-' THEN 0 ELSE (3 + 2 * instr('{HEX}', substr(qn, pos, 1)))::INT END AS q FROM (
    SELECT raw.*, p::INT AS pos, CASE WHEN substr(n, p, 1) = '0' THEN '-' WHEN substr(n, p, 1) = '1' THEN translate(substr(tt, p, 1), 'ACGT', 'CATG')
      WHEN truth = 'O' AND p IN (5, 20, 40) THEN translate(substr(tt, p, 1), 'ACGT', 'GTAC') WHEN truth = 'P' AND p IN (10, 33) THEN translate(substr(tt, p, 1), 'ACGT', 'TGCA')
      ELSE substr(tt, p, 1) END AS base
    FROM raw, tpl, (SELECT unnest(range(1, {WIDTH + 1})) AS p))),
reads AS (SELECT sample_id, read_id, read_ord, truth, string_agg(base, '' ORDER BY pos) AS aln_seq, string_agg(chr((q + 33)::INT), '' ORDER BY pos) AS aln_qual FROM bases GROUP BY ALL)"""
