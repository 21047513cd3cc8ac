"""Column statistics and rare variants: counts, background, binomial test, false-discovery control, weights."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from strandlab.config import DEFAULT, Config
from strandlab.operators.cells import cells_at, is_symbol, tally

COLUMN = ["sample_id", "pos"]


def column_counts(bases: DataFrame, *extra: str) -> DataFrame:
    """Symbol counts per (sample_id, *extra, pos)."""
    count = lambda s: F.count_if(F.col("base") == s)
    return bases.groupBy("sample_id", *extra, "pos").agg(*(count(s).alias(n) for s, n in zip("ACGTN-", ("n_a", "n_c", "n_g", "n_t", "n_n", "n_gap"), strict=True)), F.count(F.lit(1)).alias("n_all"))


def read_counts(reads: DataFrame, *extra: str) -> DataFrame:
    """``column_counts`` of reads (sample_id, *extra, aln_seq, aln_qual)."""
    return tally(reads, ["sample_id", *extra], {n: is_symbol(s) for s, n in zip("ACGTN-", ("n_a", "n_c", "n_g", "n_t", "n_n", "n_gap"), strict=True)})


def column_stats(counts: DataFrame) -> DataFrame:
    """Depth, gap fraction, non-major rate, the major base (first of A, C, G, T on ties) and the three top shares."""
    n = [F.col(c) for c in ("n_a", "n_c", "n_g", "n_t")]
    depth = n[0] + n[1] + n[2] + n[3]
    top = F.sort_array(F.array(*n), asc=False)
    share = lambda k: F.when(F.col("depth") > 0, F.get(top, F.lit(k)) / F.col("depth")).otherwise(0.0)
    major = F.when(F.col("depth") > 0, F.element_at(F.array(*map(F.lit, "ACGT")), F.array_position(F.array(*n), F.greatest(*n)).cast("int")))
    out = counts.withColumn("depth", depth).withColumn("gap_frac", F.col("n_gap") / F.col("n_all"))
    return out.withColumns({"p1": share(0), "p2": share(1), "p3": share(2), "major": major}).withColumn("nonmajor", F.when(F.col("depth") > 0, 1 - F.col("p1")).otherwise(0.0))


def median(rate: Column) -> Column:
    return F.percentile(rate, F.lit(0.5))


def number(df: DataFrame, name: str, what: str) -> DataFrame:
    """``df``, if its column ``name``, which ``what`` made, is a number."""
    kind = df.schema[name].dataType
    if not isinstance(kind, NumericType):
        raise TypeError(f"{what} must give a number, not {kind.simpleString()}")
    return df


def background(stats: DataFrame, cfg: Config = DEFAULT, fun: Callable[[Column], Column] = median) -> DataFrame:
    """Kept columns with bg: ``fun``, an aggregate, of the non-major rates of the kept columns within ``window`` places; what isn't
    finite counts 0."""
    kept = stats.where((F.col("gap_frac") <= cfg.max_gap_frac) & (F.col("depth") > 0))
    line = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(-cfg.window, cfg.window)
    out = number(kept.withColumn("bg", fun(F.col("nonmajor")).over(line)), "bg", "the background's function")
    return out.withColumn("bg", F.when(F.abs(F.col("bg")) < float("inf"), F.col("bg")).otherwise(0.0))


#: ln n! less Stirling's main terms, for n from 0 to 15; 0 has none.
SMALL = [0.0] + [math.lgamma(n + 1) - (n + 0.5) * math.log(n) + n - 0.5 * math.log(2 * math.pi) for n in range(1, 16)]
#: Terms of the continued fraction: near the mean of a million reads at p = 1/2 it takes 374.
STEPS = 400


def _stirling_rest(n: Column) -> Column:
    """ln n! - ((n + 1/2) ln n - n + ln(2 pi) / 2) for whole n."""
    m = F.greatest(n, F.lit(16)).cast("double")
    series = (F.lit(1 / 12) - (F.lit(1 / 360) - (F.lit(1 / 1260) - F.lit(1 / 1680) / (m * m)) / (m * m)) / (m * m)) / m
    return F.when(n > 15, series).otherwise(F.element_at(F.array(*map(F.lit, SMALL)), F.least(n, F.lit(15)).cast("int") + 1))


def binomial_pmf(k: Column, n: Column, p: Column) -> Column:
    """P(Binomial(n, p) = k) for 0 < k < n, by Loader's saddle-point form, which loses no digits to large factorials."""
    deviance = lambda x, mean: x * F.log(x / mean) + mean - x
    rest = _stirling_rest(n) - _stirling_rest(k) - _stirling_rest(n - k) - deviance(k, n * p) - deviance(n - k, n * (1 - p))
    return F.sqrt(n / (2 * math.pi * k * (n - k))) * F.exp(rest)


def binomial_survival(k: Column, n: Column, p: Column, steps: int = STEPS) -> Column:
    """P(Binomial(n, p) >= k) as an incomplete beta function: its continued fraction by Lentz's method, ``steps`` terms whatever n.

    The tail that the fraction converges on fast is taken, the other is its complement. Errors stay below 1e-9 up to n = 10^6.
    """
    a, b, x = k.cast("double"), (n - k + 1).cast("double"), p.cast("double")
    near = x < (a + 1) / (a + b + 2)
    tail = F.struct(F.when(near, a).otherwise(b).alias("a"), F.when(near, b).otherwise(a).alias("b"), F.when(near, x).otherwise(1 - x).alias("x"))

    def fraction(t: Column) -> Column:
        a, b, x = t["a"], t["b"], t["x"]
        away = lambda v: F.when(F.abs(v) < 1e-300, 1e-300).otherwise(v)
        d0 = 1 / away(1 - (a + b) * x / (a + 1))
        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

        def half(s: Column, term: Column) -> Column:
            part = F.struct(away(1 + term / s["c"]).alias("c"), (1 / away(1 + term * s["d"])).alias("d"), s["h"].alias("h"))
            return F.transform(F.array(part), lambda q: F.struct(q["c"].alias("c"), q["d"].alias("d"), (q["h"] * q["c"] * q["d"]).alias("h")))[0]

        def step(s: Column, m: Column) -> Column:
            even = half(s, m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)))
            both = F.transform(F.array(even), lambda q: half(q, -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))))[0]
            return F.when(F.abs(s["c"] * s["d"] - 1) < 1e-16, s).otherwise(both)

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["h"])

    front = binomial_pmf(F.greatest(F.least(k, n - 1), F.lit(1)), F.greatest(n, F.lit(2)), p) * (1 - p)
    value = F.transform(F.array(tail), fraction)[0]
    inner = F.when(near, front * value).otherwise(1 - front * a / b * value)
    return F.when(k <= 0, 1.0).when(k > n, 0.0).when(k == n, F.pow(p, n)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), inner)))


def adjust(rows: DataFrame, p: str = "p", group: str = "sample_id") -> DataFrame:
    """``rows`` with q, p adjusted by Benjamini and Hochberg within ``group``."""
    up = Window.partitionBy(group).orderBy(F.col(p).asc(), F.col("pos").asc(), F.col("base").asc())
    ranked = rows.withColumn("r", F.row_number().over(up)).withColumn("m", F.count(F.lit(1)).over(Window.partitionBy(group)))
    down = Window.partitionBy(group).orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("q", F.least(F.lit(1.0), F.min(F.col(p) * F.col("m") / F.col("r")).over(down))).drop("r", "m")


def candidates(stats: DataFrame, cfg: Config = DEFAULT, fun: Callable[[Column], Column] = median) -> DataFrame:
    """Non-major bases with enough reads and enough excess over the background, and the binomial p of their count."""
    bg = background(stats, cfg, fun)
    each = F.explode(F.array(*(F.struct(F.lit(b).alias("base"), F.col(c).alias("k")) for b, c in zip("ACGT", ("n_a", "n_c", "n_g", "n_t"), strict=True)))).alias("x")
    rows = bg.select("sample_id", "pos", "major", F.col("depth").alias("n"), "gap_frac", "bg", "p1", "p2", "p3", each).select("*", "x.base", "x.k").drop("x").where("base != major")
    p0 = F.greatest(F.least(F.greatest(F.coalesce("bg", F.lit(0.0)), F.lit(0.0)), F.lit(0.25)), F.lit(5e-4))
    rows = rows.withColumn("p0", p0).withColumn("frac", F.col("k") / F.col("n")).withColumn("delta", F.col("frac") - F.col("p0"))
    rows = rows.where((F.col("k") >= F.greatest(F.lit(cfg.min_reads), F.ceil(F.col("n") * cfg.min_frac))) & (F.col("delta") >= cfg.min_frac))
    return rows.withColumn("p", binomial_survival(F.col("k"), F.col("n"), F.col("p0")))


def rare_variants(stats: DataFrame, cfg: Config = DEFAULT, fun: Callable[[Column], Column] = median) -> DataFrame:
    """Candidates whose adjusted p is at most the false-discovery rate."""
    return adjust(candidates(stats, cfg, fun)).where(F.col("q") <= cfg.fdr)


def feature_weights(variants: DataFrame, n_reads: DataFrame) -> DataFrame:
    """``variants`` with weight; ``n_reads`` is (sample_id, n_total)."""
    spread = F.when(F.col("p2") > 0, (F.col("p2") - F.col("p3")) / F.col("p2")).otherwise(1.0)
    weight = F.greatest(F.lit(0.0), F.col("delta")) * F.log1p("n") * (1 - F.col("gap_frac")) * F.greatest(F.lit(1e-6), F.col("p1") - F.col("p2")) * (0.5 + 0.5 * spread) * F.log1p(F.col("n_total") / F.greatest(F.lit(1), F.col("k")))
    out = variants.join(n_reads, "sample_id").withColumn("w", weight)
    out = out.withColumn("w", F.when(F.isnan("w") | F.col("w").isNull() | (F.col("w") < 0), 0.0).otherwise(F.col("w")))
    total = F.sum("w").over(Window.partitionBy("sample_id"))
    return out.withColumn("weight", F.when(total == 0, 1.0).otherwise(F.col("w"))).drop("w")


def read_features(reads: DataFrame, features: DataFrame) -> DataFrame:
    """Sparse read x feature matrix: (sample_id, read_id, pos, base) where a read has a feature's base."""
    cells = cells_at(reads.select("sample_id", "read_id", "aln_seq", "aln_qual"), features)
    return cells.join(features.select("sample_id", "pos", "base"), ["sample_id", "pos", "base"]).select("sample_id", "read_id", "pos", "base")


def ambiguity_sites(counts: DataFrame, keep: DataFrame, min_count: int, cfg: Config = DEFAULT) -> DataFrame:
    """Per (sample_id, cluster): columns of ``keep`` with depth whose second base is frequent enough."""
    n = F.array("n_a", "n_c", "n_g", "n_t")
    second, depth = F.get(F.sort_array(n, asc=False), F.lit(1)), F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    hit = (depth >= cfg.min_depth) & (second >= min_count) & (second / depth >= cfg.ambig_thr)
    return counts.join(keep.select("sample_id", "pos"), COLUMN, "left_semi").groupBy("sample_id", "cluster").agg(F.count_if(hit).alias("ambig_sites"))


def ambiguity_table(reads: DataFrame, labels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, cluster, n_reads, ambig_sites) of every cluster; cluster '0', noise, is always there and has none.

    ``labels``: (sample_id, read_id, cluster). Columns that are nearly all gaps don't count.
    """
    keep = read_counts(reads).where(F.col("n_gap") / F.col("n_all") <= cfg.max_gap_frac)
    counts = read_counts(reads.select("sample_id", "read_id", "aln_seq", "aln_qual").join(labels.where("cluster != '0'"), ["sample_id", "read_id"]), "cluster")
    sites = ambiguity_sites(counts, keep, cfg.min_reads, cfg).withColumnRenamed("ambig_sites", "sites")
    sizes = labels.unionByName(labels.select("sample_id").distinct().select("sample_id", F.lit(None).cast("string").alias("read_id"), F.lit("0").alias("cluster")))
    sizes = sizes.groupBy("sample_id", "cluster").agg(F.count("read_id").alias("n_reads"))
    return sizes.join(sites, ["sample_id", "cluster"], "left").select("sample_id", "cluster", "n_reads", F.when(F.col("cluster") != "0", F.coalesce("sites", F.lit(0))).alias("ambig_sites"))


def contrast(counts: DataFrame, sizes: DataFrame, min_node: int = 10, min_minor: int = 3, least: float = 0.1) -> DataFrame:
    """(sample_id, pos, score): the greatest contrast of a group's base shares with the rest of its sample.

    ``counts`` are column counts by cluster, ``sizes`` (sample_id, cluster, m). The rest is the sample's total less
    the group: no second scan.
    """
    names = ("n_a", "n_c", "n_g", "n_t")
    total = Window.partitionBy("sample_id", "pos")
    rows = counts.join(sizes.withColumn("n", F.sum("m").over(Window.partitionBy("sample_id"))), ["sample_id", "cluster"])
    rows = rows.withColumns({f"r_{c}": F.sum(c).over(total) - F.col(c) for c in names})
    depth = lambda prefix: sum((F.col(prefix + c) for c in names[1:]), F.col(prefix + names[0]))
    gap = sum((F.abs(F.col(c) / depth("") - F.col(f"r_{c}") / depth("r_")) for c in names), F.lit(0.0)) / 2
    good = (F.col("m") >= min_node) & (F.col("m") <= F.col("n") - min_node)
    rows = rows.where(good).where((depth("") >= min_minor) & (depth("r_") >= min_minor)).withColumn("score", gap)
    return rows.groupBy("sample_id", "pos").agg(F.max("score").alias("score")).where(F.col("score") >= least)


def confidence(base: Column, q: Column) -> Column:
    """0.98 for gaps, for bases the square of their accuracy."""
    return F.when(base == "-", 0.98).otherwise(F.pow(1 - F.pow(F.lit(10.0), -q / 10), F.lit(2.0)))


def one_hot(bases: DataFrame, weights: DataFrame, fun: Callable[[Column, Column], Column] = confidence) -> DataFrame:
    """(sample_id, read_id, feature, value): ``fun`` of symbol and quality, times the column's weight; 'N' has none.

    ``weights`` is (sample_id, pos, weight).
    """
    sure = fun(F.col("base"), F.col("q"))
    name = F.concat_ws("_", "base", (F.col("pos") - 1).cast("string"))
    rows = number(bases.where("base != 'N'").withColumn("sure", sure), "sure", "the encoder's function").join(weights, COLUMN)
    return rows.select("sample_id", "read_id", name.alias("feature"), (F.col("sure") * F.col("weight")).alias("value"))


def scale_01(rows: DataFrame, value: str, group: str = "sample_id", constant: float = 1.0) -> DataFrame:
    """``rows`` with scaled: ``value`` brought to 0..1 within ``group``; ``constant`` where all are equal or none is finite."""
    w = Window.partitionBy(group)
    v = F.when(F.abs(F.col(value)) < float("inf"), F.col(value))
    lo, hi = F.min(v).over(w), F.max(v).over(w)
    return rows.withColumn("scaled", F.when(hi > lo, (F.col(value) - lo) / (hi - lo)).otherwise(F.lit(constant)))
