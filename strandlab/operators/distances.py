"""Pairwise distances within a sample. Every pair join has the sample as an equality key and i < j as a residual."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.functions import blocks
from strandlab.operators import forest

PAIR = ["sample_id", "ord_i", "ord_j"]
#: IUPAC codes by the bit mask of their bases (A 1, C 2, G 4, T 8).
IUPAC = "ACMGRSVTWYHKDBN"


def pairs(rows: DataFrame, order: str, *columns: str, within: str = "sample_id") -> DataFrame:
    """(within, ord_i, ord_j, <column>_i, <column>_j): unordered pairs of rows of a sample."""
    side = lambda n: rows.select(within, F.col(order).alias(f"ord_{n}"), *(F.col(c).alias(f"{c}_{n}") for c in columns))
    return side("i").join(side("j"), within).where("ord_i < ord_j")


def mismatches(a: Column, b: Column, strict: bool) -> Column:
    """Mismatching columns of two aligned strings: gap pairs match, a gap and a base don't.

    strict: only equal ACGT match; else symbols match if their IUPAC sets meet.
    """

    def count(x: pa.Array, y: pa.Array) -> pa.Array:
        return blocks.mismatches(x, y, strict)

    return F.arrow_udf(count, "int")(a, b)


def hamming_pairs(reads: DataFrame, strict: bool = True, seq: str = "aln_seq", order: str = "read_ord") -> DataFrame:
    """(sample_id, ord_i, ord_j, d): percentage of mismatching columns of the alignment."""
    return pairs(reads, order, seq).select(*PAIR, (100.0 * mismatches(F.col(f"{seq}_i"), F.col(f"{seq}_j"), strict) / F.length(f"{seq}_i")).alias("d"))


def held(reads: DataFrame, features: DataFrame, *sums: Column) -> DataFrame:
    """(sample_id, read_ord, held, load, <sums>): ``reads`` with the list of their features' (feature, w), the weight of all, and sums
    over x, which is such an entry together with its mean where there is one. Pairs of reads then carry all that their overlap
    needs, so that only reads are shuffled."""
    x = features.select("sample_id", "read_ord", F.struct(*(c for c in features.columns if c not in ("sample_id", "read_ord"))).alias("x"))
    lists = x.groupBy("sample_id", "read_ord").agg(F.sort_array(F.collect_list(F.struct("x.feature", "x.w"))).alias("held"), *sums)
    return reads.select("sample_id", "read_ord").join(lists, ["sample_id", "read_ord"], "left").withColumn("load", weight_of(F.col("held")))


def weight_of(entries: Column) -> Column:
    """The sum of their w, in the list's order: lists are sorted, so equal sets of features weigh the same to the last digit."""
    return F.coalesce(F.aggregate(entries, F.lit(0.0), lambda s, x: s + x["w"]), F.lit(0.0))


def shared() -> Column:
    """The weight of the features that both reads of a pair hold."""
    return weight_of(F.array_intersect("held_i", "held_j"))


def jaccard_pairs(reads: DataFrame, features: DataFrame) -> DataFrame:
    """(sample_id, ord_i, ord_j, d): weighted Jaccard distance; 1 where neither read has a feature.

    ``reads``: (sample_id, read_ord); ``features``: (sample_id, read_ord, feature, w), w >= 0.
    """
    out = pairs(held(reads, features), "read_ord", "load", "held")
    union = F.col("load_i") + F.col("load_j") - F.col("inter")
    return out.withColumn("inter", shared()).select(*PAIR, F.when(union > 0, 1 - F.col("inter") / union).otherwise(1.0).alias("d"))


def signed_cosine(reads: DataFrame, features: DataFrame, weights: DataFrame) -> DataFrame:
    """1 - cosine of the reads' centred two-hot rows [x * sqrt(w), (1 - x) * sqrt(w)].

    Centring makes both halves mirror images, so a pair's dot product is twice that of the first halves. With x sparse
    and m the column means, sum w (x_i - m)(x_j - m) needs only shared features, per-read sums and one sample sum.
    ``features``: (sample_id, read_ord, feature); ``weights``: (sample_id, feature, w).
    """
    n = reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    means = features.groupBy("sample_id", "feature").agg(F.count(F.lit(1)).alias("k")).join(n, "sample_id").join(weights, ["sample_id", "feature"]).withColumn("mean", F.col("k") / F.col("n"))
    square = means.groupBy("sample_id").agg(F.sum(F.col("w") * F.col("mean") * F.col("mean")).alias("mm"))
    rows = features.join(means.select("sample_id", "feature", "w", "mean"), ["sample_id", "feature"])
    sums = held(reads, rows, F.sum(F.col("x.w") * F.col("x.mean")).alias("xm")).withColumnRenamed("load", "xx").join(square, "sample_id", "left").fillna(0.0, ["xm", "mm"])
    out = pairs(sums, "read_ord", "xx", "xm", "mm", "held").withColumn("inter", shared())
    norm = lambda s: F.col(f"xx_{s}") - 2 * F.col(f"xm_{s}") + F.col(f"mm_{s}")
    dot = F.col("inter") - F.col("xm_i") - F.col("xm_j") + F.col("mm_i")
    size = norm("i") * norm("j")
    return out.select(*PAIR, F.when(size > 1e-18, 1 - dot / F.sqrt(size)).otherwise(1.0).alias("d"))


def euclid_pairs(rows: DataFrame, order: str, vector: str, within: str) -> DataFrame:
    """(within, ord_i, ord_j, d) of the pairs of a group's vectors, in tiles: blocks of rows meet, not rows, few and large ones, so that a row
    is shuffled as often as its group has blocks, and a task makes some rows of a tile at a time."""
    kind = rows.schema[within].dataType.simpleString()
    named = rows.select(F.col(within).alias("sample_id"), F.col(order).alias("ord"), F.col(vector).alias("vec"))

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                (x, a), (y, b) = next(forest.sides_of(r))
                for part in forest.slices(len(a), len(b)):
                    d = forest.tile_distances(a[part], b)
                    i, j = np.nonzero(np.arange(part.start, part.stop)[:, None] < np.arange(len(b))) if r.block_a == r.block_b else np.indices(d.shape).reshape(2, -1)
                    p, q = x[part][i], y[j]
                    new = p != q
                    yield pd.DataFrame({within: r.sample_id, "ord_i": np.minimum(p, q), "ord_j": np.maximum(p, q), "d": d[i, j]})[new]

    tiles = forest.block_pairs(forest.blocks_of(named.where("sample_id is not null and ord is not null"), forest.TILE // 4, most=4))
    return tiles.mapInPandas(each, f"{within} {kind}, ord_i long, ord_j long, d double")


def mixed_distance(jaccard: DataFrame, embedded: DataFrame, coverage: DataFrame, min_feat: int = 10, cfg: Config = DEFAULT) -> DataFrame:
    """lambda * dj + (1 - lambda) * du, each side over its sample's median (0 or none: 1).

    A read's lambda falls from lambda_max to lambda_min as its features reach ``min_feat``; a pair takes the greater.
    ``coverage``: (sample_id, read_ord, cov).
    """

    def scaled(df: DataFrame, name: str) -> DataFrame:
        med = df.groupBy("sample_id").agg(F.percentile("d", F.lit(0.5)).alias("med"))
        unit = F.when(F.coalesce("med", F.lit(0.0)) == 0, 1.0).otherwise(F.col("med"))
        return df.join(med, "sample_id").select(*PAIR, (F.col("d") / unit).alias(name))

    lam = coverage.select("sample_id", "read_ord", (cfg.lambda_max - (cfg.lambda_max - cfg.lambda_min) * F.least(F.lit(1.0), F.col("cov") / min_feat)).alias("lam"))
    side = lambda s: lam.select("sample_id", F.col("read_ord").alias(f"ord_{s}"), F.col("lam").alias(f"lam_{s}"))
    out = scaled(jaccard, "dj").join(scaled(embedded, "du"), PAIR).join(side("i"), ["sample_id", "ord_i"]).join(side("j"), ["sample_id", "ord_j"])
    lj = F.least(F.greatest("lam_i", "lam_j", F.lit(cfg.lambda_min)), F.lit(cfg.lambda_max))
    lu = F.greatest(1 - lj, F.lit(cfg.floor_kmer))
    return out.select(*PAIR, ((lj * F.col("dj") + lu * F.col("du")) / (lj + lu)).alias("d"))


def ecdf_power(df: DataFrame, value: str, power: Column, within: str = "sample_id") -> DataFrame:
    """``df`` with ecdf: the share of the sample's values up to this one, to a power."""
    return df.withColumn("ecdf", F.pow(F.cume_dist().over(Window.partitionBy(within).orderBy(value)), power))


def outlier_flags(labels: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Noise or a score at the threshold makes an outlier; a sample of noise only becomes one cluster of inliers."""
    none = F.max("label").over(Window.partitionBy("sample_id")) == 0
    flag = (F.col("label") == 0) | (F.col("score") >= cfg.outlier_threshold)
    return labels.select("sample_id", "read_id", F.when(none, 1).otherwise(F.col("label")).alias("cluster_id"), F.when(none, 0).otherwise(flag.cast("int")).alias("is_outlier"))


def sweep_score(sweep: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """Scores and objective of evaluated parameters, scaled within the sample.

    ``sweep``: (sample_id, min_pts, n_clusters, max_size, in_cluster, noise_frac, prob_mean, stability_mean,
    ambig_bases, ambig_bases_raw).
    """
    w = Window.partitionBy("sample_id")

    def unit(v: Column, constant: float) -> Column:
        lo, hi = F.min(v).over(w), F.max(v).over(w)
        return F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(F.lit(constant))

    mixed = 0.5 * unit(F.col("ambig_bases"), 0.0) + 0.5 * unit(F.col("ambig_bases_raw"), 0.0)
    room = F.greatest(F.col("in_cluster"), 10 * F.col("min_pts"))
    parsimony = F.when(room > 0, F.col("max_size") / room).otherwise(0.0) / F.log1p("min_pts")
    out = sweep.withColumns({"c": mixed, "par": parsimony})
    ambig = 1 - F.pow("c", F.lit(0.6))
    ambig = F.when(F.col("c").between(0.5, 0.6), F.least(ambig, F.lit(0.80))).when((F.col("c") >= 0.35) & (F.col("c") < 0.5), F.least(ambig, F.lit(0.90))).otherwise(ambig)
    out = out.withColumns({"s_noise": unit(1 - F.col("noise_frac"), 1.0), "s_prob": unit(F.col("prob_mean"), 1.0), "s_stab": unit(F.col("stability_mean"), 1.0), "s_ambig": ambig, "s_parsimony": unit(F.col("par"), 1.0)})
    total = sum(abs(x) for x in cfg.weights)
    parts = [F.col(c) * (x / total) for c, x in zip(("s_noise", "s_prob", "s_stab", "s_ambig", "s_parsimony"), cfg.weights, strict=True)]
    objective = sum(parts[1:], parts[0])
    return out.withColumn("objective", F.when(F.col("n_clusters") > 0, objective).otherwise(objective * 0.5)).drop("c", "par")
