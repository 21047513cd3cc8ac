"""The plan's order, guards and quarantine on planted reads."""

import random

import pytest
from pyspark.sql import functions as F

from strandlab.config import Config
from strandlab.operators import quality, samples, variants
from strandlab.plans import denoise

READ = "sample_id string, read_id string, read_ord long, aln_seq string, aln_qual string"


def noisy(rng, t, rate=0.01):
    return "".join(rng.choice("ACGT") if rng.random() < rate else b for b in t)


def planted(sample, seqs, n, q="I", rng=None, rate=0.01):
    rng = rng or random.Random(sample)
    return [(sample, f"{sample}{k}", k, s := noisy(rng, seqs[k % len(seqs)], rate), q * len(s)) for k in range(n)]


def test_clustering_sees_the_trimmed_columns(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("ACGT") for _ in range(30)).replace("AAA", "CAT")
    # half the reads lose bases of a homopolymer; nothing else tells them apart
    long, short = t[:15] + "AAAAAAAA" + t[15:], t[:15] + "AAAAA---" + t[15:]
    out = denoise.run(spark.createDataFrame(planted("s", [long, short], 60, rng=rng, rate=0.0), READ))
    assert {r.cluster_id for r in out.clusters.collect()} == {1}
    assert out.features.count() == 0 and out.removal_report.first().removed >= 8
    assert {len(r.seq) for r in out.consensus.collect()} == {38}


def test_features_count_trimmed_and_whole_columns(spark):
    rng = random.Random(2)
    t = [("CGT", "GTC", "TCG")[k % 3][rng.randrange(2)] for k in range(60)]
    t[10:18] = "AAAAAAAA"
    u = ["A" if k in (5, 30, 50) else b for k, b in enumerate(t)]
    out = denoise.run(spark.createDataFrame(planted("s", ["".join(t), "".join(u)], 60, rng=rng), READ))
    strong = {(r.pos, r.aln_pos) for r in out.features.where("k > 20").collect()}
    assert {a for _, a in strong} == {6, 31, 51} and {a - p for p, a in strong if a > 20} == {8}
    assert len({r.seq for r in out.summary.collect()}) == 2
    table = {r.cluster: (r.n_reads, r.ambig_sites) for r in out.ambiguity.collect()}
    labels = [r.cluster_id for r in out.clusters.collect()]
    assert table["0"] == (labels.count(0), None) and sum(n for n, _ in table.values()) == len(labels)


def test_small_samples_are_errors(spark):
    rows = planted("nine", ["ACGTTGCA" * 5], 9, rate=0.0) + planted("five", ["ACGTTGCA" * 5], 5) + planted("good", ["ACGTTGCA" * 5], 30, rate=0.0)
    out = denoise.run(spark.createDataFrame(rows, READ))
    assert {(r.sample_id, r.stage) for r in out.errors.collect()} == {("nine", "clustering"), ("five", "quality filter")}
    assert {r.sample_id for r in out.summary.collect()} == {"good"}
    got = samples.clusters(spark.createDataFrame(rows, READ), spark.createDataFrame([], "sample_id string, pos int, base string, weight double"))
    assert {r.sample_id for r in got.collect()} == {"good"}


def test_headers_follow_the_first_pass(spark):
    rng = random.Random(3)
    t = "".join(rng.choice("ACGT") for _ in range(40))
    one = denoise.run(spark.createDataFrame(planted("s", [t], 40, rate=0.0), READ)).summary.collect()
    assert len(one) == 1 and one[0].header.startswith("CL1_IAD0_IMD0_NIUPAC0_NSEQ40") and "MDC" not in one[0].header
    stats = spark.createDataFrame([("a", "1+2", "ACGT", 12, 1.0, 0.5, 0.25, 0, 4, False)], "sample_id string, cluster string, seq string, n_seq long, imd double, iad double, mdc double, n_iupac int, len int, only boolean")
    from strandlab.operators import consensus

    assert consensus.label(stats, single=F.col("only")).first().header == "CL1_2_IMD1.00_MDC0.25_NIUPAC0_NSEQ12_LEN4"


def test_accuracy_filter_comes_before_mean_quality_and_alignment(spark):
    seen = []
    rows = [("s", f"r{k} x", k, "ACGTACGTAC", ("5" if k == 0 else "I") * 10) for k in range(40)]

    def aligner(reads):
        seen.extend(r.read_id for r in reads.collect())
        return reads.select("sample_id", "read_id", "read_ord", F.col("seq").alias("aln_seq"))

    out = denoise.align(spark.createDataFrame(rows, "sample_id string, read_id string, read_ord long, seq string, qual string"), aligner=aligner)
    # quality 20 passes the mean of 16, so only the accuracy filter takes the read
    assert "r0" not in seen and len(seen) == 39 and out.errors.count() == 0
    assert out.filter_report.first().reads_removed == 1 and out.report.first().seq_count == 39


def test_one_failing_sample_does_not_stop_the_others(spark):
    rows = [(s, f"{s}{k}", k, "ACGTACGTAC", "I" * 10) for s in ("bad", "good") for k in range(20)]

    def fail(pdf):
        if pdf.sample_id.iloc[0] == "bad":
            raise ValueError("no luck")
        return samples._align(pdf)

    run, schema = samples.guarded(fail, samples.ALIGNED)
    out = denoise.align(spark.createDataFrame(rows, "sample_id string, read_id string, read_ord long, seq string, qual string"), aligner=lambda r: r.select("sample_id", "read_id", "read_ord", "seq").groupBy("sample_id").applyInPandas(run, schema))
    assert [(r.sample_id, r.stage, r.message) for r in out.errors.collect()] == [("bad", "align", "ValueError: no luck")]
    assert out.reads.where("sample_id = 'good'").count() == 20


def test_clustering_failure_is_an_error_row(spark, monkeypatch):
    rows = spark.createDataFrame(planted("s", ["ACGTTGCA" * 5], 12), READ)
    odd = rows.unionAll(spark.createDataFrame([("t", f"t{k}", k, "ACGT"[: 2 + k % 2], "IIII"[: 2 + k % 2]) for k in range(12)], READ))
    got = samples.guarded_clusters(odd, spark.createDataFrame([], "sample_id string, pos int, base string, weight double")).collect()
    assert {r.sample_id for r in got if r.error is None} == {"s"} and len([r for r in got if r.error]) == 1


def test_accuracy_within_the_row(spark):
    rows = spark.createDataFrame([("5I", "A-"), ("5I", "AC"), ("", ""), (None, None), ("!", "-")], "qual string, seq string")
    got = rows.select(quality.accuracy(F.col("qual")).alias("a"), quality.accuracy(F.col("qual"), F.col("seq")).alias("b")).collect()
    assert [r.a for r in got] == pytest.approx([99.495, 99.495, None, None, 0.0]) and [r.b for r in got] == pytest.approx([99.0, 99.495, None, None, None])
    assert "Exchange" not in rows.select(quality.accuracy(F.col("qual")))._jdf.queryExecution().toString()


def test_fasta_mode(spark, tmp_path):
    rng = random.Random(5)
    t = "".join(rng.choice("ACGT") for _ in range(50))
    (tmp_path / "s_refined.fasta").write_text("".join(f">r{k}\n{t[:25]}\n{t[25:]}\n" for k in range(20)))
    out = denoise.run_files(spark, str(tmp_path), mode="fasta")
    denoise.write(out, str(tmp_path / "out"))
    assert t in "".join(f.read_text() for f in (tmp_path / "out" / "final").glob("part*"))
    assert spark.read.parquet(f"file://{tmp_path}/out/tables/align_report").first().seq_count == 20
    assert list((tmp_path / "out" / "merged").glob("sample_id=s/*/part*"))
