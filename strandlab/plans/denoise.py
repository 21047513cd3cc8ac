"""The whole plan: reads to filtered reads, variants, clusters, consensuses, merged consensuses and a summary."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.operators import consensus, masking, quality, samples, variants
from strandlab.sources import files
from strandlab.sources.ledger import Ledger
from strandlab.stages import cut

ERROR = "sample_id string, stage string, message string"


def too_few(sizes: DataFrame, least: int, stage: str) -> DataFrame:
    """Errors (sample_id, stage, message) of the samples of fewer than ``least`` reads. ``sizes``: (sample_id, n)."""
    return sizes.where(F.col("n") < least).select("sample_id", F.lit(stage).alias("stage"), F.concat(F.lit("too few reads: "), F.col("n").cast("string")).alias("message"))


def sizes_of(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))


def succeeded(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """``rows`` of the samples that no stage has stopped."""
    return rows.join(errors.select("sample_id").distinct(), "sample_id", "left_anti")


def split_errors(rows: DataFrame, stage: str) -> tuple[DataFrame, DataFrame]:
    """A guarded kernel's results, and its failures as errors. Rows without the column ``error`` have none."""
    if "error" not in rows.columns:
        return rows, rows.sparkSession.createDataFrame([], ERROR)
    failed = rows.where("error is not null").select("sample_id", F.lit(stage).alias("stage"), F.col("error").alias("message"))
    return rows.where("error is null").drop("error"), failed


@dataclass
class Aligned:
    reads: DataFrame
    filter_report: DataFrame
    report: DataFrame
    errors: DataFrame


def align(raw: DataFrame, cfg: Config = DEFAULT, aligner: Callable[[DataFrame], DataFrame] = samples.guarded_align, mad: bool = True) -> Aligned:
    """Raw reads (sample_id, read_id, read_ord, seq, qual) to aligned ones, with reports per sample.

    Reads of low accuracy go first (``mad``), then those of low mean quality; what is left is aligned, so that discarded reads
    shape neither. ``aligner`` makes (sample_id, read_id, read_ord, aln_seq) of them, and may tell failures in a column
    ``error``. A sample with a bad read, with too few reads, with ids that repeat up to the first space or whose alignment fails is a
    row in ``errors``; the others go on.
    """
    bad = files.invalid_reads(raw).groupBy("sample_id", "stage").agg(F.min("message").alias("message"))
    good = raw.join(bad.select("sample_id"), "sample_id", "left_anti")
    good = cut(good.withColumns({"acc": quality.accuracy(F.col("qual")), "avg_q": quality.mean_q(F.col("qual"))}))
    acc = good.select("sample_id", F.col("read_ord").alias("read_id"), "acc")
    report = quality.filter_report(acc, cfg)
    small = too_few(sizes_of(good), 6, "quality filter") if mad else raw.sparkSession.createDataFrame([], ERROR)
    solid = good.join(quality.mad_filter(acc, cfg).select("sample_id", F.col("read_id").alias("read_ord")), ["sample_id", "read_ord"], "left_semi") if mad else good
    solid = solid.withColumn("read_id", F.substring_index("read_id", " ", 1))
    kept = quality.min_q_guard(solid, cfg)
    twice = quality.duplicate_ids(kept).select("sample_id").distinct()
    few = solid.select("sample_id").distinct().join(kept.select("sample_id").distinct(), "sample_id", "left_anti")
    kept = cut(kept.join(twice, "sample_id", "left_anti"))
    stopped = [df.select("sample_id", F.lit("align").alias("stage"), F.lit(why).alias("message")) for df, why in ((few, "too few reads of enough quality"), (twice, "ids repeat"))]
    out, failed = split_errors(cut(aligner(kept)), "align")
    out = out.join(kept.select("sample_id", "read_id", "qual", "avg_q"), ["sample_id", "read_id"])
    out = cut(out.join(quality.regap_quality(out), ["sample_id", "read_id"]))
    of_alignment = quality.align_report(out)
    errors = bad.unionAll(small).unionAll(stopped[0]).unionAll(stopped[1]).unionAll(failed)
    return Aligned(out.select("sample_id", "read_id", "read_ord", "aln_seq", "aln_qual"), report, of_alignment, errors)


@dataclass
class Results:
    filtered: DataFrame
    features: DataFrame
    clusters: DataFrame
    ambiguity: DataFrame
    consensus: DataFrame
    merged: DataFrame
    pooled: DataFrame
    summary: DataFrame
    errors: DataFrame
    filter_report: DataFrame | None = None
    align_report: DataFrame | None = None
    removal_report: DataFrame | None = None


#: The parameters that each stage's results depend on, besides its input.
DEPENDS = {
    "align": ("max_removal_fraction", "mad_threshold", "min_avg_qual"),
    "cluster": (
        "min_len", "homopolymer_threshold", "gap_fraction_cutoff", "di_rep", "tri_rep", "use_di_tri", "window", "max_gap_frac", "min_frac", "min_reads", "fdr", "ambig_thr", "min_depth",
        "floor_kmer", "lambda_min", "lambda_max", "grid", "extra_min_pts", "weights", "selection_epsilon", "outlier_threshold",
    ),
    "consensus": ("min_cluster_size", "iupac_min_count", "iupac_min_prop", "phred_threshold", "hp_len_consensus", "hp_threshold_consensus", "hp_gap_consensus"),
    "merge": (
        "min_cluster_size", "iupac_min_count", "iupac_min_prop", "phred_threshold", "hp_len_consensus", "hp_threshold_consensus", "hp_gap_consensus", "max_pairs_reads", "max_pairwise_distance", "iupac_guard",
        "iupac_delta_abs", "iupac_delta_rel", "hp_mask_in_merge", "drop_rejected",
    ),
}


def params(stage: str, cfg: Config, **more: object) -> dict:
    value = lambda name: getattr(cfg, name)() if callable(getattr(cfg, name)) else getattr(cfg, name)
    return {name: value(name) for name in DEPENDS[stage]} | more


def cluster(reads: DataFrame, cfg: Config = DEFAULT, mad: bool = True) -> dict[str, DataFrame]:
    """Aligned reads to filtered reads, features, clusters, ambiguity, removal_report and errors."""
    reads = reads.select("sample_id", "read_id", "read_ord", "aln_seq", "aln_qual").withColumn("truth", F.lit(None).cast("string"))
    errors = reads.sparkSession.createDataFrame([], ERROR)
    filtered = reads
    if mad:
        errors = errors.unionAll(too_few(sizes_of(reads), 6, "quality filter"))
        kept = quality.mad_filter(reads.select("sample_id", "read_id", quality.accuracy(F.col("aln_qual"), F.col("aln_seq")).alias("acc")), cfg).select("sample_id", "read_id")
        filtered = reads.join(kept, ["sample_id", "read_id"], "left_semi")
    filtered = cut(filtered)
    errors = cut(errors.unionAll(too_few(sizes_of(filtered), samples.MIN_READS, "clustering")))
    filtered = succeeded(filtered, errors)
    mask = cut(masking.column_mask(filtered, cfg.min_len, cfg.homopolymer_threshold, cfg.gap_fraction_cutoff, ((2, cfg.di_rep), (3, cfg.tri_rep)) if cfg.use_di_tri else ()))
    strings = cut(masking.trim(filtered, mask).select("sample_id", "read_id", "aln_seq", "aln_qual", "read_ord"))
    # columns are numbered anew; aln_pos is their place in the whole alignment
    line = Window.partitionBy("sample_id").orderBy("pos")
    kept_at = mask.where("not masked").select("sample_id", F.col("pos").alias("aln_pos"), F.row_number().over(line).alias("pos"))
    bare = filtered.select("sample_id").distinct().join(strings.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", F.lit("clustering").alias("stage"), F.lit("no column left").alias("message"))
    stats = variants.column_stats(variants.read_counts(strings)).join(kept_at, ["sample_id", "pos"])
    features = cut(variants.feature_weights(variants.rare_variants(stats, cfg), sizes_of(filtered).withColumnRenamed("n", "n_total")).join(stats.select("sample_id", "pos", "aln_pos"), ["sample_id", "pos"]))
    clusters, failed = split_errors(cut(samples.guarded_clusters(strings, features, cfg)), "clustering")
    ambiguity = variants.ambiguity_table(strings, clusters.select("sample_id", "read_id", F.col("cluster_id").cast("string").alias("cluster")), cfg)
    return {"filtered": filtered, "features": features, "clusters": clusters, "ambiguity": ambiguity, "removal_report": masking.removal_report(mask), "errors": errors.unionAll(bare).unionAll(failed)}


def inliers(labelled: DataFrame) -> DataFrame:
    """The reads that count for their cluster, with the whole alignment."""
    return labelled.where("is_outlier = 0 and cluster_id > 0").select("sample_id", F.col("cluster_id").cast("string").alias("cluster"), "read_id", "read_ord", "aln_seq", "aln_qual")


def call(labelled: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Filtered reads with their labels to first-pass consensuses and errors."""
    cons = cut(consensus.consensus(inliers(labelled), cfg))
    none = labelled.select("sample_id").distinct().join(cons.select("sample_id").distinct(), "sample_id", "left_anti")
    return {"consensus": cons, "errors": none.select("sample_id", F.lit("consensus").alias("stage"), F.lit("no cluster has enough reads").alias("message"))}


def merge(labelled: DataFrame, cons: DataFrame, cfg: Config = DEFAULT) -> dict[str, DataFrame]:
    """Labelled reads and first-pass consensuses to merged groups, their pooled reads, and the summary."""
    solid = inliers(labelled)
    d = cut(consensus.merge_distances(consensus.trimmed(cons, consensus.merge_mask(cons))))
    groups = consensus.single_linkage(cons, d, cfg.max_pairwise_distance)
    first = groups.groupBy("sample_id", "group").agg(F.min("cluster").alias("seed"))
    both = d.select("sample_id", F.col("ord_i").alias("seed"), F.col("ord_j").alias("cluster"), "d")
    groups = groups.join(first, ["sample_id", "group"]).join(both, ["sample_id", "seed", "cluster"], "left").fillna(0, ["d"])
    merged = cut(samples.guarded_merge(groups.select("sample_id", "cluster", "group", "d"), consensus.read_ballots(solid, cfg), cfg))
    back = merged.select("sample_id", "merged_id", F.explode("members").alias("cluster"))
    pooled = solid.join(back, ["sample_id", "cluster"]).drop("cluster").withColumnRenamed("merged_id", "cluster")
    members = cut(labelled.drop("cluster_id", "is_outlier").join(pooled.select("sample_id", "read_id", "cluster").distinct(), ["sample_id", "read_id"]))
    # a sample's only consensus passes as the first pass made it, masked and under its header; others are called anew
    single = Window.partitionBy("sample_id")
    only = cons.withColumn("n", F.count(F.lit(1)).over(single)).where("n = 1").drop("n")
    final = consensus.consensus(pooled.join(only.select("sample_id"), "sample_id", "left_anti"), cfg, mask=cfg.hp_mask_in_merge)
    final = cut(final.select("sample_id", "cluster", "seq", "n_seq", F.lit(False).alias("only")).unionAll(only.select("sample_id", "cluster", "seq", "n_seq", F.lit(True))))
    summary = consensus.divergence(members, final, cfg).join(final.select("sample_id", "cluster", "only"), ["sample_id", "cluster"])
    summary = consensus.label(summary, single=F.col("only")).drop("only")
    # where nothing merges, the first pass's consensuses stand under their numbers, without statistics
    rest = cons.join(merged.select("sample_id").distinct(), "sample_id", "left_anti")
    summary = summary.unionByName(rest.select("sample_id", "cluster", "seq", "n_seq", F.concat(F.lit("CL"), "cluster").alias("header")), allowMissingColumns=True)
    return {"merged": merged, "pooled": members, "summary": summary}


def run(reads: DataFrame, cfg: Config = DEFAULT, mad: bool = True, ledger: Ledger | None = None) -> Results:
    """Denoise aligned reads (sample_id, read_id, read_ord, aln_seq, aln_qual); clustering sees the trimmed columns,
    consensus the untrimmed ones. A sample that a guard or an exception stops is a row in ``errors``; the others go on.

    ``mad``: filter reads by accuracy first, as reads that come aligned have not been. Positions of ``features`` count the
    trimmed columns, ``aln_pos`` the whole alignment's. With ``ledger``, stages keep what they did for a sample and do what is left.
    """
    do = ledger.run if ledger else lambda stage, inputs, params, work: work(inputs)
    one = do("cluster", reads, params("cluster", cfg, mad=mad) | (params("align", cfg) if mad else {}), lambda r: cluster(r, cfg, mad))
    labelled = cut(one["filtered"].drop("truth").join(one["clusters"], ["sample_id", "read_id"]))
    two = do("consensus", labelled, params("consensus", cfg), lambda r: call(r, cfg))
    # the merge depends on the reads as well as on their consensuses: the latter go along in the fingerprint
    known = two["consensus"].groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("cluster", "seq", "n_seq"))).alias("held"))
    three = do("merge", labelled.join(known, "sample_id"), params("merge", cfg), lambda r: merge(r.drop("held"), r.select("sample_id", "held").distinct().select("sample_id", F.inline("held")), cfg))
    errors = one.pop("errors").unionAll(two["errors"])
    return Results(**one, consensus=two["consensus"], **three, errors=errors)


def run_files(spark: SparkSession, path: str, cfg: Config = DEFAULT, done: DataFrame | None = None, aligner: Callable[[DataFrame], DataFrame] = samples.guarded_align, mode: str = "fastq", ledger: Ledger | None = None) -> Results:
    """Denoise the files at ``path``, a sample each, but for samples in ``done``; errors and reports of all stages together.

    ``mode`` fasta: sequences without qualities, which get a constant one and aren't filtered by accuracy. With ``ledger``, a run
    goes on after the last stage that an earlier one finished for a sample, as long as its reads and parameters are the same.
    """
    if mode == "fasta":
        rows = files.read_fasta(spark, path, cfg=cfg).select("sample_id", F.col("header").alias("read_id"), "read_ord", F.col("seq").alias("aln_seq"))
        raw = quality.fasta_to_reads(rows, cfg, "read_ord")
    else:
        raw = files.read_fastq(spark, path, cfg=cfg)
    raw = cut(files.pending(raw, done) if done is not None else raw)

    def work(reads: DataFrame) -> dict[str, DataFrame]:
        out = align(reads, cfg, aligner, mad=mode != "fasta")
        return {"reads": out.reads, "filter_report": out.filter_report, "report": out.report, "errors": out.errors}

    start = ledger.run("align", raw, params("align", cfg, mode=mode), work) if ledger else work(raw)
    out = run(start["reads"], cfg, mad=False, ledger=ledger)
    return replace(out, errors=start["errors"].unionAll(out.errors), filter_report=start["filter_report"], align_report=start["report"])


def write(out: Results, path: str) -> None:
    """Reads per cluster (outliers marked in their ids), consensuses, merged reads, final sequences, and tables of labels, features,
    ambiguity, reports, summary and errors under ``path``."""
    reads = out.filtered.join(out.clusters.where("cluster_id > 0"), ["sample_id", "read_id"]).repartition("sample_id", "cluster_id")
    name = F.concat(F.lit(">"), "read_id", F.when(F.col("is_outlier") > 0, "_OUTLIER").otherwise(""))
    rows = reads.sortWithinPartitions("sample_id", "cluster_id", "is_outlier", "read_ord").select("sample_id", "cluster_id", F.concat(name, F.lit("\n"), "aln_seq").alias("value"))
    rows.write.mode("overwrite").partitionBy("sample_id", "cluster_id").text(f"{path}/clusters")
    files.write_fasta(out.consensus.withColumn("name", F.concat("sample_id", F.lit("__CL"), "cluster")), f"{path}/consensus")
    merged = out.pooled.repartition("sample_id", "cluster").sortWithinPartitions("sample_id", "cluster", "read_ord")
    merged.select("sample_id", "cluster", F.concat(F.lit(">"), "read_id", F.lit("\n"), "aln_seq").alias("value")).write.mode("overwrite").partitionBy("sample_id", "cluster").text(f"{path}/merged")
    for name in ("clusters", "features", "ambiguity", "filter_report", "align_report", "removal_report"):
        if (table := getattr(out, name)) is not None:
            table.write.mode("overwrite").parquet(f"{path}/tables/{name}")
    summary = cut(out.summary)
    files.write_fasta(consensus.final_results(summary), f"{path}/final")
    summary.write.mode("overwrite").parquet(f"{path}/summary")
    out.errors.write.mode("overwrite").parquet(f"{path}/errors")
