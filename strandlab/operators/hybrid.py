"""The hybrid distance as pair tables: weighted Jaccard and centred signed cosine, mixed by measures of the whole sample.

A pair's row is made once and kept (``cut``); the sample's measures are aggregates over pairs, reads and features. Ranks over all
pairs of a sample come from counts of equal values and their running sums, so a large sample's pairs are never sorted in one
task: only their distinct values are. Values are compared at nine digits, since sums in another order differ beyond.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.operators.distances import PAIR, held, pairs, shared
from strandlab.stages import cut

DIGITS = 9


def normalised(weights: DataFrame) -> DataFrame:
    """(sample_id, feature, w) with weights that sum to 1: those not finite or not positive count 0, all alike where none is left."""
    w = F.when((F.col("w") > 0) & (F.col("w") < float("inf")) & ~F.isnan("w"), F.col("w")).otherwise(0.0)
    sample = Window.partitionBy("sample_id")
    total, n = F.sum("w").over(sample), F.count(F.lit(1)).over(sample)
    return weights.select("sample_id", "feature", w.alias("w")).withColumn("w", F.when(total > 0, F.col("w") / total).otherwise(1 / n))


def feature_measures(reads: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """Per sample: entropy (mean, of prevalence in bits), middle (share of features between the quartiles of prevalence), spread."""
    n = reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    held = features.groupBy("sample_id", "feature").agg(F.count(F.lit(1)).alias("k"))
    rows = weights.join(n, "sample_id").join(held, ["sample_id", "feature"], "left").select("sample_id", (F.coalesce("k", F.lit(0)) / F.col("n")).alias("raw"))
    rows = rows.withColumn("p", F.greatest(F.lit(1e-12), F.least("raw", F.lit(1 - 1e-12))))
    ends = rows.groupBy("sample_id").agg(F.percentile("p", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    rows = rows.join(ends, "sample_id")
    entropy = -(F.col("p") * F.log2("p") + (1 - F.col("p")) * F.log2(1 - F.col("p")))
    inside = F.col("p").between(F.get("q", F.lit(0)), F.get("q", F.lit(1))).cast("double")
    return rows.groupBy("sample_id").agg(F.avg(entropy).alias("entropy"), F.avg(inside).alias("middle"), (1 - F.percentile("raw", F.lit(0.5))).alias("spread"))


def pair_parts(reads: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, ord_i, ord_j, load_i, load_j, u, jac, cos): loads, union load and both distances of every pair of reads.

    Centring makes the halves of the two-hot rows mirror images, so that dot products need only shared features, per-read
    sums and one sum per sample.
    """
    n = reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    having = features.groupBy("sample_id", "feature").agg(F.count(F.lit(1)).alias("k"))
    means = weights.join(having, ["sample_id", "feature"]).join(n, "sample_id").select("sample_id", "feature", "w", (F.col("k") / F.col("n")).alias("mean"))
    square = means.groupBy("sample_id").agg(F.sum(F.col("w") * F.col("mean") * F.col("mean")).alias("mm"))
    rows = features.join(means, ["sample_id", "feature"])
    sums = held(reads, rows, F.sum(F.col("x.w") * F.col("x.mean")).alias("xm")).join(square, "sample_id", "left").fillna(0.0, ["xm", "mm"])
    out = pairs(sums, "read_ord", "load", "xm", "mm", "held").withColumn("inter", shared())
    norm = lambda s: F.col(f"load_{s}") - 2 * F.col(f"xm_{s}") + F.col(f"mm_{s}")
    dot = F.col("inter") - F.col("xm_i") - F.col("xm_j") + F.col("mm_i")
    union = F.col("load_i") + F.col("load_j") - F.col("inter")
    jac = F.when(union > 0, 1 - F.col("inter") / union).otherwise(1.0)
    cos = F.when((norm("i") > DIGITS_OFF) & (norm("j") > DIGITS_OFF), 1 - dot / F.sqrt(norm("i") * norm("j"))).otherwise(1.0)
    return out.select(*PAIR, "load_i", "load_j", union.alias("u"), jac.alias("jac"), cos.alias("cos"))


#: Below this a squared norm is what rounding leaves of 0.
DIGITS_OFF = 1e-13


def with_rank(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the share of its sample's rows up to this value; and the row count and the two least ranks of the sample.

    ``name`` is a struct (rank, total, least, second), second being that of the second row in order.
    """
    df = df.withColumn("v_", F.round(value, DIGITS))
    counts = df.groupBy("sample_id", "v_").agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy("sample_id").orderBy("v_").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("sample_id")
    counts = counts.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(whole)})
    least = F.min("upto").over(whole)
    second = F.coalesce(F.min(F.when(F.col("upto") >= 2, F.col("upto"))).over(whole), least)
    share = lambda c: c / F.col("total")
    counts = counts.select("sample_id", "v_", F.struct(share(F.col("upto")).alias("rank"), "total", share(least).alias("least"), share(second).alias("second")).alias(name))
    return df.join(counts, ["sample_id", "v_"]).drop("v_")


def _shaped(rank: Column, raw: Column, deficit: Column) -> Column:
    """Ranks to a power, not below the quantile of one in ``total``, which lies between the two least ranks."""
    power = 1 / (1 + deficit)
    low, next_ = F.pow(rank["least"], power), F.pow(rank["second"], power)
    floor_ = low + (next_ - low) * F.when(rank["total"] > 1, (rank["total"] - 1) / rank["total"]).otherwise(0.0)
    return F.when(deficit > 0, F.greatest(F.pow(rank["rank"], power), floor_)).otherwise(raw)


def hybrid_pairs(reads: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """(sample_id, ord_i, ord_j, d): the adaptive mix of both distances; 0 in samples without features.

    ``reads``: (sample_id, read_ord); ``features``: (sample_id, read_ord, feature) where a read has one; ``weights``:
    (sample_id, feature, w), every feature of the sample.
    """
    weights = normalised(weights)
    parts = cut(with_rank(pair_parts(reads, features, weights), "jac", "e"))
    of_pairs = parts.groupBy("sample_id").agg(
        F.percentile("e.rank", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"),
        F.avg(F.greatest(F.lit(0.0), F.col("cos") - F.col("jac"))).alias("for_s"), F.avg(F.greatest(F.lit(0.0), F.col("jac") - F.col("cos"))).alias("for_j"),
    )
    loads = reads.select("sample_id", "read_ord").join(features.join(weights, ["sample_id", "feature"]).groupBy("sample_id", "read_ord").agg(F.sum("w").alias("load")), ["sample_id", "read_ord"], "left").fillna(0.0, ["load"])
    thin = loads.where("load > 0").groupBy("sample_id").agg(F.percentile("load", F.lit(0.25)).alias("thin"))
    # the median of union loads goes over the full square: every pair twice, and each read with itself
    square = parts.select("sample_id", "u", F.lit(2).alias("times")).unionAll(loads.select("sample_id", "load", F.lit(1))).where("u > 0")
    tau = square.groupBy("sample_id").agg(F.percentile("u", F.lit(0.5), F.col("times")).alias("tau"))
    m = of_pairs.join(feature_measures(reads, features, weights), "sample_id").join(thin, "sample_id", "left").join(tau, "sample_id", "left")
    deficit = F.get("q", F.lit(1)) * (1 - (F.get("q", F.lit(2)) - F.get("q", F.lit(0))))
    w_pos = F.greatest(F.lit(0.0), F.least(F.lit(0.5), F.col("entropy") * F.col("deficit") * (1 - F.col("middle"))))
    adv = F.when(F.col("for_s") + F.col("for_j") > 0, F.col("for_s") / (F.col("for_s") + F.col("for_j"))).otherwise(0.0)
    m = m.withColumn("deficit", deficit).withColumns({"w_pos": w_pos, "adv": adv})
    m = m.withColumn("w_sig", (1 - F.col("w_pos")) * F.col("adv") * 0.5).withColumn("w_fus", 1 - F.col("w_pos") - F.col("w_sig"))
    m = m.select("sample_id", "deficit", "w_pos", "adv", "spread", "w_sig", "w_fus", "thin", F.coalesce("tau", F.lit(1.0)).alias("tau"))
    x = parts.drop("e").join(m, "sample_id")
    jac, cos, g = F.col("jac"), F.col("cos"), F.col("g")
    gi = lambda s: F.coalesce(F.least(F.lit(1.0), F.col(f"load_{s}") / F.col("thin")), F.lit(0.0))
    x = x.withColumns({"g": F.col("u") / (F.col("u") + F.col("tau")), "gate": F.sqrt(gi("i") * gi("j"))})
    gain = F.greatest(F.lit(0.0), cos - jac) / F.greatest(F.lit(1e-12), F.abs(cos) + F.abs(jac))
    boost = F.least(F.col("w_fus"), 0.5 * F.col("adv") * F.col("spread") * (1 - g) * gain * (1 - F.col("w_pos")))
    x = x.withColumn("boost", boost)
    pair = (F.col("w_fus") - F.col("boost") + F.col("w_pos")) * jac + (F.col("w_sig") + F.col("boost")) * cos
    bad = F.col("w_pos") * jac + (1 - F.col("w_pos")) * cos
    x = x.select(*PAIR, "deficit", "g", "gate", ((F.col("w_fus") + F.col("w_pos")) * jac + F.col("w_sig") * cos).alias("m1"), ((0.5 + 0.5 * F.col("gate")) * (g * pair + (1 - g) * bad)).alias("m2"))
    x = with_rank(with_rank(cut(x), "m1", "r1"), "m2", "r2")
    alpha = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (1 - g) + 0.5 * (1 - F.col("gate"))))
    d = alpha * _shaped(F.col("r1"), F.col("m1"), F.col("deficit")) + (1 - alpha) * _shaped(F.col("r2"), F.col("m2"), F.col("deficit"))
    out = x.select(*PAIR, F.greatest(F.lit(0.0), d).alias("d"))
    bare = pairs(reads.join(weights.select("sample_id").distinct(), "sample_id", "left_anti"), "read_ord").select(*PAIR, F.lit(0.0).alias("d"))
    return out.unionAll(bare)
