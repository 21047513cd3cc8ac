"""Queries on reads: accuracy, quality filters, gapped qualities, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import quality as q
from strandlab.plans import fixture
from strandlab.plans.catalog import query

READS, SMALL = fixture.sql(8), fixture.sql(None)
ACC = "acc AS (SELECT sample_id, read_id, avg(100 * (1 - pow(10.0, -q / 10.0))) AS acc FROM bases GROUP BY ALL)"
MEANQ = "mq AS (SELECT sample_id, read_id, -10 * log10(greatest(avg(pow(10.0, -q / 10.0)), 1e-10)) AS avg_q FROM bases GROUP BY ALL)"


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Round for the comparison of two engines."""
    return df.withColumns({n: F.round(n, digits) for n in names})


def long(spark: SparkSession, sf_dir: str, samples: int | None = 8, runs: bool = False) -> DataFrame:
    return fixture.bases(fixture.aligned(spark, sf_dir, samples, runs))


@query("read_accuracy", f"WITH {READS}, {ACC} SELECT sample_id, read_id, round(acc, 6) AS acc FROM acc")
def read_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(q.read_accuracy(long(spark, sf_dir)), "acc")


@query("read_mean_q", f"WITH {READS}, {MEANQ} SELECT sample_id, read_id, round(avg_q, 6) AS avg_q FROM mq")
def read_mean_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(q.read_mean_q(long(spark, sf_dir)), "avg_q")


THRESHOLDS = f"""WITH {SMALL}, {ACC},
med AS (SELECT sample_id, count(*) AS total, quantile_cont(acc, 0.5) AS med FROM acc GROUP BY ALL),
mad AS (SELECT sample_id, quantile_cont(abs(acc - med), 0.5) AS mad FROM acc JOIN med USING (sample_id) GROUP BY ALL),
t0 AS (SELECT *, CASE WHEN total < 10 THEN 1 ELSE floor(total * 0.1)::BIGINT END AS max_rm, med - 3.0 * mad AS cut,
  row_number() OVER (PARTITION BY sample_id ORDER BY acc, read_id) AS place FROM acc JOIN med USING (sample_id) JOIN mad USING (sample_id)),
t1 AS (SELECT *, sum((acc < cut)::INT) OVER s AS n_below, max(CASE WHEN place = max_rm + 1 THEN acc END) OVER s AS kth FROM t0 WINDOW s AS (PARTITION BY sample_id)),
t2 AS (SELECT *, CASE WHEN n_below > max_rm THEN kth ELSE cut END AS threshold FROM t1),
t3 AS (SELECT *, sum((acc >= threshold)::INT) OVER (PARTITION BY sample_id) AS n_kept FROM t2),
t AS (SELECT *, CASE WHEN n_kept < 5 THEN place > total - 5 ELSE acc >= threshold END AS kept FROM t3)"""


@query("mad_filter", f"{THRESHOLDS} SELECT sample_id, read_id, round(acc, 6) AS acc FROM t WHERE total >= 6 AND kept")
def mad_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(q.mad_filter(q.read_accuracy(long(spark, sf_dir, None))), "acc")


@query(
    "filter_report",
    f"""{THRESHOLDS} SELECT sample_id, total AS reads_before, CASE WHEN total >= 6 THEN sum((NOT kept)::INT)::DOUBLE END AS reads_removed,
    CASE WHEN total >= 6 THEN round(avg(acc), 6) END AS acc_before, CASE WHEN total >= 6 THEN round(avg(acc) FILTER (kept), 6) END AS acc_after,
    CASE WHEN total >= 6 THEN round(max(threshold), 6) END AS threshold,
    CASE WHEN total < 6 THEN 'too_few' WHEN max(n_kept) < 5 THEN 'forced_min5' WHEN max(n_below) > max(max_rm) THEN 'quantile_5%' ELSE 'mad_based' END AS method
    FROM t GROUP BY sample_id, total""",
)
def filter_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = q.filter_report(q.read_accuracy(long(spark, sf_dir, None)))
    return r6(out.withColumn("reads_removed", F.col("reads_removed").cast("double")), "acc_before", "acc_after", "threshold")


@query("min_q_guard", f"WITH {SMALL}, {MEANQ} SELECT sample_id, read_id, round(avg_q, 6) AS avg_q FROM mq WHERE avg_q >= 9 QUALIFY count(*) OVER (PARTITION BY sample_id) > 10")
def min_q_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a minimum of 9, which the derived reads straddle."""
    return r6(q.min_q_guard(q.read_mean_q(long(spark, sf_dir, None)), q.Config(min_avg_qual=9.0)), "avg_q")


@query("dup_ids", "SELECT l_suppkey::VARCHAR AS sample_id, concat(l_orderkey, '-', l_linenumber) AS read_id, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    ids = F.concat_ws(" ", F.concat_ws("-", "l_orderkey", "l_linenumber"), "l_partkey")
    return q.duplicate_ids(lines.select(F.col("l_suppkey").cast("string").alias("sample_id"), ids.alias("read_id")))


@query("fasta_dummy_quality", f"WITH {READS} SELECT sample_id, read_id, replace(aln_seq, '-', '') AS seq, repeat('7', len(replace(aln_seq, '-', ''))) AS qual FROM reads")
def fasta_dummy_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.fasta_to_reads(fixture.aligned(spark, sf_dir))


@query(
    "accuracy_histogram",
    f"""WITH {READS}, {ACC}, e AS (SELECT sample_id, min(acc) AS lo, max(acc) AS hi FROM acc GROUP BY ALL)
    SELECT sample_id, (CASE WHEN hi > lo THEN least(59, floor((acc - lo) / (hi - lo) * 60)) ELSE 0 END)::INT AS bin, count(*) AS n FROM acc JOIN e USING (sample_id) GROUP BY 1, 2""",
)
def accuracy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.accuracy_histogram(q.read_accuracy(long(spark, sf_dir)))


@query("regap_quality", f"WITH {READS} SELECT sample_id, read_id, aln_qual FROM reads")
def regap_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From raw qualities (the gapped ones without gaps) back to gapped ones."""
    reads = fixture.aligned(spark, sf_dir)
    return q.regap_quality(reads.select("sample_id", "read_id", "aln_seq", F.replace("aln_qual", F.lit("!"), F.lit("")).alias("qual")))


@query(
    "align_report",
    f"""WITH {READS}, {MEANQ}, s AS (SELECT *, len(aln_seq) AS w, len(replace(aln_seq, '-', '')) AS l FROM reads)
    SELECT sample_id, count(*) AS seq_count, max(w)::INT AS len_after_aln, round(avg(l), 6) AS avg_len_before_aln, min(l)::INT AS min_len_before_aln,
    round(100 * sum(w - l) / sum(w), 6) AS gap_perc_after_aln, round(avg(avg_q), 6) AS avg_qual_score_before_aln FROM s JOIN mq USING (sample_id, read_id) GROUP BY ALL""",
)
def align_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fixture.aligned(spark, sf_dir)
    out = q.align_report(reads.withColumn("avg_q", q.mean_q(F.col("aln_qual"))))
    return r6(out, "avg_len_before_aln", "gap_perc_after_aln", "avg_qual_score_before_aln")
