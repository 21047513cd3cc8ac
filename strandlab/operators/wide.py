"""Clustering of samples too large for one worker: every step of the clustering plan as tables.

Pairs of reads with the mixed distance, a spanning forest per (sample, min_pts), the measures of all candidates in parallel, the
sweep's rules as a filter over them, and the winner's labels. Work is quadratic in a sample's reads, as its distances are, but
is spread over tasks; what one task holds is linear in them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.operators import distances, forest, hybrid, replay, variants
from strandlab.stages import cut

MIN_READS = 10


@dataclass
class Clustering:
    labels: DataFrame
    sweep: DataFrame


def mixed_pairs(reads: DataFrame, features: DataFrame, weights: DataFrame, vectors: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, ord_i, ord_j, d): the hybrid distance of variants mixed with the Euclidean distance of ``vectors``.

    ``reads`` and ``vectors`` (with vec): (sample_id, read_ord); ``features``: (sample_id, read_ord, feature); ``weights``: (sample_id, feature, w).
    """
    cover = features.groupBy("sample_id", "read_ord").agg(F.count(F.lit(1)).alias("cov"))
    cover = reads.select("sample_id", "read_ord").join(cover, ["sample_id", "read_ord"], "left").fillna(0, ["cov"])
    du = distances.euclid_pairs(vectors, "read_ord", "vec", "sample_id")
    return distances.mixed_distance(cut(hybrid.hybrid_pairs(reads, features, weights)), cut(du), cover, cfg.min_depth, cfg)


def key(sample: str = "sample_id", min_pts: str = "min_pts") -> Column:
    return F.concat_ws("\x01", sample, F.col(min_pts).cast("string"))


def cluster_candidates(nodes: DataFrame, pairs: DataFrame, candidates: DataFrame, epsilon: float) -> DataFrame:
    """(sample_id, min_pts, ord, label, probability, outlier) for every candidate (sample_id, min_pts), all at once."""
    most = candidates.agg(F.max("min_pts")).first()[0] or 1
    near = cut(forest.neighbours(pairs, max(1, most - 1)))
    asked = candidates.select("sample_id", "min_pts", (F.col("min_pts") - 1).alias("r"))
    core = near.join(asked, ["sample_id", "r"]).select("sample_id", "min_pts", "ord", F.col("d").alias("core"))
    core = core.unionByName(nodes.join(asked.where("r < 1"), "sample_id").select("sample_id", "min_pts", "ord", F.lit(0.0).alias("core")))
    core = cut(core.select(key().alias("sample_id"), "ord", "core"))
    many = pairs.join(asked, "sample_id").select(key().alias("sample_id"), "ord_i", "ord_j", "d")
    edges = cut(forest.reachability(many, core))
    points = cut(nodes.join(asked, "sample_id").select(key().alias("sample_id"), "ord", "min_pts"))
    found = forest.tree_clusters(points, forest.spanning_forest(points, forest.pair_edges(edges)), None, epsilon)
    part = F.split("sample_id", "\x01")
    return found.select(F.get(part, F.lit(0)).alias("sample_id"), F.get(part, F.lit(1)).cast("int").alias("min_pts"), "ord", "label", "probability", "outlier")


def measures(labels: DataFrame, bases: DataFrame, min_count: int = 3, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, min_pts, the sweep's measures) of clusterings (sample_id, min_pts, ord, label, probability).

    ``bases``: long (sample_id, read_ord, pos, base). Columns that are nearly all gaps don't count. Clusters under 10 reads are left out;
    those under 100 are, in the order of their labels, while the reads left out this way stay within a tenth of the largest cluster.
    """
    run = ["sample_id", "min_pts"]
    inside = F.col("label") > 0
    whole = labels.groupBy(*run).agg(
        F.count(F.lit(1)).alias("n"), F.avg((~inside).cast("double")).alias("noise_frac"), F.avg("probability").alias("prob_mean"),
        F.coalesce(F.avg(F.when(inside, F.col("probability"))), F.lit(0.0)).alias("stability_mean"), F.count_if(inside).alias("in_cluster"),
    )
    keep = variants.column_counts(bases).where(F.col("n_gap") / F.col("n_all") <= cfg.max_gap_frac).select("sample_id", "pos")
    kept = bases.join(keep, ["sample_id", "pos"]).select("sample_id", F.col("read_ord").alias("ord"), "pos", "base")
    deep = Config(min_depth=max(10, cfg.min_depth), ambig_thr=cfg.ambig_thr)

    def ambiguous(cells: DataFrame) -> DataFrame:
        """Ambiguous columns per cluster of cells under one key."""
        counts = variants.column_counts(cells, "cluster")
        return variants.ambiguity_sites(counts, counts.select("sample_id", "pos").distinct(), min_count, deep)

    sizes = labels.where(inside).groupBy(*run, "label").agg(F.count(F.lit(1)).alias("size"))
    cells = kept.join(labels.where(inside).select(*run, "ord", "label"), ["sample_id", "ord"]).select(F.struct(*run).alias("sample_id"), F.col("label").alias("cluster"), "pos", "base")
    sites = ambiguous(cells).select("sample_id.*", F.col("cluster").alias("label"), F.col("ambig_sites").alias("a"))
    rows = F.array_sort(F.collect_list(F.struct("label", "size", F.coalesce("a", F.lit(0)).alias("a"))))
    groups = sizes.join(sites, [*run, "label"], "left").groupBy(*run).agg(rows.alias("x"), F.max("size").alias("max_size"), F.count(F.lit(1)).alias("n_clusters"))
    alone = ambiguous(kept.select("sample_id", F.lit(0).alias("cluster"), "pos", "base")).select("sample_id", F.col("ambig_sites").alias("all_a"))
    out = whole.join(groups, run, "left").join(alone, "sample_id", "left")
    start = F.struct(F.lit(0).cast("long").alias("spent"), F.lit(0).cast("long").alias("raw"), F.lit(0.0).alias("weighted"))
    room = F.bround(0.1 * F.col("max_size"))

    def fold(s: Column, c: Column) -> Column:
        left_out = (c["size"] < 100) & (s["spent"] + c["size"] <= room)
        counted = F.struct(s["spent"].alias("spent"), (s["raw"] + c["a"]).alias("raw"), (s["weighted"] + c["size"] / F.col("n") * c["a"]).alias("weighted"))
        return F.when(c["size"] < 10, s).when(left_out, F.struct((s["spent"] + c["size"]).alias("spent"), s["raw"].alias("raw"), s["weighted"].alias("weighted"))).otherwise(counted)

    out = out.withColumn("f", F.aggregate("x", start, fold))
    none = F.col("x").isNull()
    every = F.coalesce("all_a", F.lit(0)).cast("double")
    return out.select(
        *run, F.coalesce("n_clusters", F.lit(0)).cast("int").alias("n_clusters"), F.coalesce("max_size", F.lit(0)).alias("max_size"), "in_cluster", "noise_frac", "prob_mean", "stability_mean",
        F.when(none, every).otherwise(F.col("f.weighted")).alias("ambig_bases"), F.when(none, every).otherwise(F.col("f.raw").cast("double")).alias("ambig_bases_raw"),
    )


def clusters(bases: DataFrame, pairs: DataFrame, cfg: Config = DEFAULT) -> Clustering:
    """Labels (sample_id, read_ord, cluster_id, is_outlier) and the sweep's table (``replay``) of samples of ``MIN_READS`` reads or more.

    ``bases``: long trimmed bases; ``pairs``: every pair of a sample's reads (sample_id, ord_i, ord_j, d). A sample without a value to
    try, or whose best value finds noise alone, is one cluster.
    """
    nodes = bases.select("sample_id", F.col("read_ord").alias("ord")).distinct()
    sizes = cut(nodes.groupBy("sample_id").agg(F.count(F.lit(1)).cast("int").alias("n")).where(F.col("n") >= MIN_READS))
    nodes, pairs = cut(nodes.join(sizes.select("sample_id"), "sample_id")), cut(pairs.join(sizes.select("sample_id"), "sample_id"))
    found = cut(cluster_candidates(nodes, pairs, replay.candidates(sizes, cfg), cfg.selection_epsilon))
    sweep = cut(replay.replay(cut(measures(found, bases, cfg=cfg)), sizes, cfg))
    best = found.join(sweep.where("rank = 1").select("sample_id", "min_pts"), ["sample_id", "min_pts"])
    rows = nodes.join(best, ["sample_id", "ord"], "left")
    noise = F.max(F.coalesce("label", F.lit(0))).over(Window.partitionBy("sample_id")) == 0
    outlier = (F.col("label") == 0) | (F.col("outlier") >= cfg.outlier_threshold)
    labels = rows.select("sample_id", F.col("ord").alias("read_ord"), F.when(noise, 1).otherwise(F.col("label")).alias("cluster_id"), F.when(noise, 0).otherwise(outlier.cast("int")).alias("is_outlier"))
    return Clustering(labels, sweep)
