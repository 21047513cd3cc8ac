"""Queries on alignment columns: masks, statistics, rare variants, encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import masking as m
from strandlab.operators import variants as v
from strandlab.operators.cells import cells_at
from strandlab.plans import fixture
from strandlab.plans.catalog import query
from strandlab.plans.reads import r6
from strandlab.stages import cut

READS, RUNS = fixture.sql(8), fixture.sql(8, True)
HP = """
h0 AS (SELECT *, last_value(CASE WHEN base <> '-' THEN base END IGNORE NULLS) OVER (PARTITION BY sample_id, read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS lb FROM bases),
h1 AS (SELECT *, (base <> '-' AND (coalesce(lag(lb) OVER (PARTITION BY sample_id, read_id ORDER BY pos), '') <> base OR base NOT IN ('A', 'C', 'G', 'T')))::INT AS st FROM h0),
h2 AS (SELECT *, sum(st) OVER (PARTITION BY sample_id, read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM h1),
hp AS (SELECT sample_id, read_id, pos, base, q, coalesce(count(*) FILTER (base <> '-') OVER (PARTITION BY sample_id, read_id, run) >= 5 AND lb IN ('A', 'C', 'G', 'T'), false) AS hp FROM h2),
cols AS (SELECT sample_id, pos, avg(hp::INT) AS share, avg((base = '-')::INT) AS gap_frac FROM hp GROUP BY ALL)"""
MASK = """
i0 AS (SELECT sample_id, pos, share >= 0.33 AS anchor, gap_frac, share >= 0.33 OR gap_frac > 0.0625 AS inn FROM cols),
i1 AS (SELECT *, pos - sum(inn::INT) OVER (PARTITION BY sample_id ORDER BY pos) AS island FROM i0),
mask AS (SELECT sample_id, pos, anchor, gap_frac, inn AND coalesce(max(CASE WHEN inn THEN anchor::INT END) OVER (PARTITION BY sample_id, island), 0) = 1 AS masked FROM i1)"""
#: The derived reads have one base in sixteen missing, so a cutoff of 0.0625 makes islands.
CUTOFF = 0.0625


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.column_mask(fixture.aligned(spark, sf_dir, runs=True), cutoff=CUTOFF)


@query("homopolymer_flags", f"WITH {RUNS}, {HP} SELECT sample_id, read_id, pos, hp FROM hp WHERE hp")
def homopolymer_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.homopolymer_flags(fixture.aligned(spark, sf_dir, runs=True))


@query("homopolymer_columns", f"WITH {RUNS}, {HP} SELECT sample_id, pos, round(share, 6) AS share, share >= 0.33 AS anchor FROM cols")
def homopolymer_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.homopolymer_columns(fixture.aligned(spark, sf_dir, runs=True)), "share")


def repeats_sql(unit: int, times: int) -> str:
    motif = "".join(f"substr(d, i + {k}, 1)," for k in range(unit))
    return f"""SELECT DISTINCT sample_id, read_id, pos FROM (
      SELECT sample_id, read_id, unnest(ps[i:i + {unit * times - 1}]) AS pos FROM (
        SELECT sample_id, read_id, d, ps, unnest(range(1, len(d) - {unit * times} + 2)) AS i FROM dg)
      WHERE substr(d, i, {unit * times}) = repeat(concat({motif[:-1]}), {times}))"""


@query(
    "repeat_mask",
    f"""WITH {RUNS}, dg AS (SELECT sample_id, read_id, string_agg(base, '' ORDER BY pos) AS d, list(pos ORDER BY pos) AS ps FROM bases WHERE base <> '-' GROUP BY ALL)
    SELECT sample_id, pos, count(DISTINCT read_id) AS n_reads FROM ({repeats_sql(2, 6)} UNION {repeats_sql(3, 6)}) GROUP BY ALL""",
)
def repeat_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that a di- or trinucleotide repeat covers in some read, and in how many."""
    return m.repeat_columns(fixture.aligned(spark, sf_dir, runs=True), (2, 6), (3, 6))


@query("gap_islands", f"WITH {RUNS}, {HP}, {MASK} SELECT sample_id, pos, anchor, round(gap_frac, 6) AS gap_frac, masked FROM mask")
def gap_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(mask(spark, sf_dir), "gap_frac")


@query(
    "trimmed_alignment",
    f"""WITH {RUNS}, {HP}, {MASK} SELECT sample_id, read_id, string_agg(base, '' ORDER BY pos) AS aln_seq, string_agg(chr((q + 33)::INT), '' ORDER BY pos) AS aln_qual
    FROM bases JOIN mask USING (sample_id, pos) WHERE NOT masked GROUP BY ALL""",
)
def trimmed_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.trim(fixture.aligned(spark, sf_dir, runs=True), cut(mask(spark, sf_dir))).select("sample_id", "read_id", "aln_seq", "aln_qual")


@query(
    "removal_report",
    f"""WITH {RUNS}, {HP}, {MASK} SELECT sample_id, count(*) AS original, sum(masked::INT)::BIGINT AS removed, (count(*) - sum(masked::INT))::BIGINT AS remaining,
    round(100 * sum(masked::INT) / count(*), 6) AS percent_removed FROM mask GROUP BY ALL""",
)
def removal_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(m.removal_report(mask(spark, sf_dir)), "percent_removed")


COUNTS = "counts AS (SELECT sample_id, pos, " + ", ".join(f"count(*) FILTER (base = '{s}') AS {n}" for s, n in zip("ACGTN-", ("n_a", "n_c", "n_g", "n_t", "n_n", "n_gap"), strict=True)) + ", count(*) AS n_all FROM bases GROUP BY ALL)"
STATS = f"""{COUNTS},
s0 AS (SELECT *, n_a + n_c + n_g + n_t AS depth, n_gap / n_all AS gap_frac, list_sort([n_a, n_c, n_g, n_t], 'DESC') AS top FROM counts),
stats AS (SELECT *, CASE WHEN depth > 0 THEN top[1] / depth ELSE 0 END AS p1, CASE WHEN depth > 0 THEN top[2] / depth ELSE 0 END AS p2, CASE WHEN depth > 0 THEN top[3] / depth ELSE 0 END AS p3,
  CASE WHEN depth = 0 THEN NULL WHEN n_a = top[1] THEN 'A' WHEN n_c = top[1] THEN 'C' WHEN n_g = top[1] THEN 'G' ELSE 'T' END AS major, CASE WHEN depth > 0 THEN 1 - top[1] / depth ELSE 0 END AS nonmajor FROM s0)"""
BG = f"{STATS}, bg AS (SELECT *, quantile_cont(nonmajor, 0.5) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN 60 PRECEDING AND 60 FOLLOWING) AS bg FROM stats WHERE gap_frac <= 0.9 AND depth > 0)"
VARIANTS = f"""{BG},
v0 AS (SELECT sample_id, pos, major, depth AS n, gap_frac, bg, p1, p2, p3, base, k, greatest(least(greatest(bg, 0), 0.25), 5e-4) AS p0 FROM (
  SELECT *, unnest(['A', 'C', 'G', 'T']) AS base, unnest([n_a, n_c, n_g, n_t]) AS k FROM bg) WHERE base <> major),
v1 AS (SELECT *, k / n AS frac, k / n - p0 AS delta FROM v0 WHERE k >= greatest(5, ceil(n * 0.01)) AND k / n - p0 >= 0.01),
v2 AS (SELECT *, least(1.0, list_sum(list_transform(range(k, n + 1), lambda x: exp(lgamma(n + 1) - lgamma(x + 1) - lgamma(n - x + 1) + x * ln(p0) + (n - x) * ln(1 - p0))))) AS p FROM v1),
v3 AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY p, pos, base) AS r, count(*) OVER (PARTITION BY sample_id) AS m FROM v2),
adj AS (SELECT *, least(1.0, min(p * m / r) OVER (PARTITION BY sample_id ORDER BY r DESC ROWS UNBOUNDED PRECEDING)) AS q FROM v3),
variants AS (SELECT * FROM adj WHERE q <= 0.1)"""
WEIGHTS = f"""{VARIANTS},
tot AS (SELECT sample_id, count(DISTINCT read_id) AS n_total FROM bases GROUP BY ALL),
feats AS (SELECT *, greatest(0, delta) * ln(1 + n) * (1 - gap_frac) * greatest(1e-6, p1 - p2) * (0.5 + 0.5 * CASE WHEN p2 > 0 THEN (p2 - p3) / p2 ELSE 1 END) * ln(1 + n_total / greatest(1, k)) AS weight FROM variants JOIN tot USING (sample_id))"""


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.column_stats(v.read_counts(fixture.aligned(spark, sf_dir)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixture.aligned(spark, sf_dir).groupBy("sample_id").agg(F.count(F.lit(1)).alias("n_total"))
    return v.feature_weights(v.rare_variants(stats(spark, sf_dir)), n)


@query("col_counts", f"WITH {READS}, {COUNTS} SELECT * FROM counts")
def col_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read_counts(fixture.aligned(spark, sf_dir))


@query("col_stats", f"WITH {READS}, {STATS} SELECT sample_id, pos, depth, round(gap_frac, 6) AS gap_frac, round(nonmajor, 6) AS nonmajor, major, round(p1, 6) AS p1, round(p2, 6) AS p2, round(p3, 6) AS p3 FROM stats")
def col_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats(spark, sf_dir).select("sample_id", "pos", "depth", "gap_frac", "nonmajor", "major", "p1", "p2", "p3")
    return r6(out, "gap_frac", "nonmajor", "p1", "p2", "p3")


@query("quantile_vector", f"WITH {READS}, {STATS} SELECT sample_id, i, round(quantile_cont(nonmajor, pow(i / 50.0, 5)), 6) AS v FROM stats, (SELECT unnest(range(0, 51)) AS i) GROUP BY ALL" if False else f"WITH {READS}, {STATS}, z AS (SELECT sample_id, quantile_cont(nonmajor, [{', '.join(repr((i / 50) ** 5) for i in range(51))}]) AS qs FROM stats GROUP BY ALL) SELECT sample_id, unnest(range(0, 51))::INT AS i, round(unnest(qs), 6) AS v FROM z")
def quantile_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of the non-major rate at probabilities skewed by a power of five."""
    probs = F.array(*(F.lit((i / 50) ** 5) for i in range(51)))
    out = stats(spark, sf_dir).groupBy("sample_id").agg(F.percentile("nonmajor", probs).alias("qs"))
    return r6(out.select("sample_id", F.posexplode("qs").alias("i", "v")), "v")


@query(
    "ambiguity_sites",
    f"""WITH {READS}, {STATS}, c AS (SELECT sample_id, truth AS cluster, pos, list_sort([count(*) FILTER (base = 'A'), count(*) FILTER (base = 'C'), count(*) FILTER (base = 'G'), count(*) FILTER (base = 'T')], 'DESC') AS top FROM bases GROUP BY ALL)
    SELECT sample_id, cluster, count(*) FILTER (list_sum(top) >= 10 AND top[2] >= 5 AND top[2] / list_sum(top) >= 0.04) AS ambig_sites
    FROM c SEMI JOIN (SELECT * FROM stats WHERE gap_frac <= 0.9 AND depth > 0) k USING (sample_id, pos) GROUP BY ALL""",
)
def ambiguity_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per planted cluster, at a share of 0.04, which the noise of the derived reads straddles."""
    reads = fixture.aligned(spark, sf_dir).withColumnRenamed("truth", "cluster")
    keep = stats(spark, sf_dir).where("gap_frac <= 0.9 and depth > 0")
    return v.ambiguity_sites(v.read_counts(reads, "cluster"), keep, 5, v.Config(ambig_thr=0.04))


@query("background", f"WITH {READS}, {BG} SELECT sample_id, pos, round(nonmajor, 6) AS nonmajor, round(bg, 6) AS bg FROM bg")
def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(v.background(stats(spark, sf_dir)).select("sample_id", "pos", "nonmajor", "bg"), "nonmajor", "bg")


@query("bh_adjust", f"WITH {READS}, {VARIANTS} SELECT sample_id, pos, base, k, round(p, 6) AS p, round(q, 6) AS q FROM adj")
def bh_adjust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(v.adjust(v.candidates(stats(spark, sf_dir))).select("sample_id", "pos", "base", "k", "p", "q"), "p", "q")


@query("minmax", f"WITH {READS}, {STATS} SELECT sample_id, pos, round((nonmajor - min(nonmajor) OVER s) / (max(nonmajor) OVER s - min(nonmajor) OVER s), 6) AS scaled FROM stats WINDOW s AS (PARTITION BY sample_id)")
def minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(v.scale_01(stats(spark, sf_dir), "nonmajor").select("sample_id", "pos", "scaled"), "scaled")


@query("rare_variants", f"WITH {READS}, {VARIANTS} SELECT sample_id, pos, base, k, n, round(frac, 6) AS frac, round(bg, 6) AS bg, round(delta, 6) AS delta, round(q, 6) AS q FROM variants")
def rare_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = v.rare_variants(stats(spark, sf_dir)).select("sample_id", "pos", "base", "k", "n", "frac", "bg", "delta", "q")
    return r6(out, "frac", "bg", "delta", "q")


@query("feature_weights", f"WITH {READS}, {WEIGHTS} SELECT sample_id, pos, base, round(weight, 6) AS weight FROM feats")
def feature_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(features(spark, sf_dir).select("sample_id", "pos", "base", "weight"), "weight")


@query("read_features", f"WITH {READS}, {VARIANTS} SELECT sample_id, read_id, pos, base FROM bases SEMI JOIN variants USING (sample_id, pos, base)")
def read_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.read_features(fixture.aligned(spark, sf_dir), cut(v.rare_variants(stats(spark, sf_dir))))


CONTRAST = """
cc AS (SELECT sample_id, truth AS cluster, pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(DISTINCT read_id) AS m FROM bases GROUP BY ALL),
cr AS (SELECT *, sum(a) OVER w - a AS ra, sum(c) OVER w - c AS rc, sum(g) OVER w - g AS rg, sum(t) OVER w - t AS rt, sum(m) OVER w AS n FROM cc WINDOW w AS (PARTITION BY sample_id, pos)),
cs AS (SELECT sample_id, pos, max(0.5 * (abs(a / (a+c+g+t) - ra / (ra+rc+rg+rt)) + abs(c / (a+c+g+t) - rc / (ra+rc+rg+rt)) + abs(g / (a+c+g+t) - rg / (ra+rc+rg+rt)) + abs(t / (a+c+g+t) - rt / (ra+rc+rg+rt)))) AS score
  FROM cr WHERE m >= 10 AND m <= n - 10 AND a+c+g+t >= 3 AND ra+rc+rg+rt >= 3 GROUP BY ALL HAVING score >= 0.1)"""


def contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = fixture.aligned(spark, sf_dir).withColumnRenamed("truth", "cluster")
    return v.contrast(v.read_counts(reads, "cluster"), reads.groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("m")))


@query("contrast", f"WITH {READS}, {CONTRAST} SELECT sample_id, pos, round(score, 6) AS score FROM cs")
def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(contrasts(spark, sf_dir), "score")


@query("onehot", f"WITH {READS}, {CONTRAST} SELECT sample_id, read_id, concat(base, '_', pos - 1) AS feature, round(score * CASE WHEN base = '-' THEN 0.98 ELSE pow(1 - pow(10.0, -q / 10.0), 2) END, 6) AS value FROM bases JOIN cs USING (sample_id, pos)")
def onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = cut(contrasts(spark, sf_dir).withColumnRenamed("score", "weight"))
    return r6(v.one_hot(cells_at(fixture.aligned(spark, sf_dir).drop("truth", "read_ord"), weights), weights), "value")
