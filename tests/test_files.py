import math
import random

from pyspark.sql import functions as F

from strandlab.operators import quality
from strandlab.plans import denoise, fixture
from strandlab.sources import files


def test_round_trip(spark, tmp_path):
    (tmp_path / "s1_refined.fastq").write_text("@r1 x\nacgt\n+\n@III\n@r2\nAC\n+r2\nII\n")
    (tmp_path / "s2_refined.fasta").write_text(">a\nAC\nGT\n>b c\nA\n")
    got = sorted(map(tuple, files.read_fastq(spark, str(tmp_path)).collect()))
    assert got == [("s1", "r1 x", 0, "ACGT", "@III"), ("s1", "r2", 1, "AC", "II")]
    fasta = sorted(map(tuple, files.read_fasta(spark, str(tmp_path)).collect()))
    assert fasta == [("s2", "a", 0, "ACGT"), ("s2", "b c", 1, "A")]
    files.write_fastq(files.read_fastq(spark, str(tmp_path)), str(tmp_path / "out"))
    part = next((tmp_path / "out" / "sample_id=s1").glob("part*"))
    assert part.read_text() == "@r1 x\nACGT\n+\n@III\n@r2\nAC\n+\nII\n"


def test_denoise_recovers_planted_sequences(spark, sf):
    out = denoise.run(fixture.aligned(spark, sf, 4))
    seqs = {r.seq for r in out.summary.collect()}
    assert len(out.summary.collect()) >= 4 and all(len(s) == fixture.WIDTH for s in seqs)


def test_mean_q_within_the_row(spark):
    rows = spark.createDataFrame([("5?I",), ("",), ("I\x1f",), (None,)], "qual string").select(quality.mean_q(F.col("qual")).alias("q")).collect()
    assert abs(rows[0].q + 10 * math.log10((0.01 + 0.001 + 0.0001) / 3)) < 1e-9 and [r.q for r in rows[1:]] == [100, None, None]


def test_files_to_files(spark, tmp_path):
    rng = random.Random(4)
    t = [rng.choice("ACGT") for _ in range(60)]
    u = ["ACGT"["ACGT".index(b) - 1] if i in (7, 23, 41) else b for i, b in enumerate(t)]

    def record(i, s, q="I", name=None):
        s = "".join(rng.choice("ACGT") if rng.random() < 0.01 else b for b in s)
        return f"@{name or f'r{i}'} run=1\n{s}\n+\n{q * len(s)}\n"

    both = [record(i, (t, u)[i % 2]) for i in range(60)]
    texts = {"good": [*both, record(99, t, "#")], "few": both[:9], "weak": [record(i, t, "#") for i in range(20)], "twice": [*both[:15], both[0]], "broken": [*both[:20], "@odd\nACGT\n+\nII\n"], "old": both}
    for name, records in texts.items():
        (tmp_path / f"{name}_refined.fastq").write_text("".join(records))
    done = spark.createDataFrame([("old",)], "sample_id string")
    out = denoise.run_files(spark, str(tmp_path), done=done)
    assert {(r.sample_id, r.stage) for r in out.errors.collect()} == {("few", "align"), ("weak", "align"), ("twice", "align"), ("broken", "input")}
    denoise.write(out, str(tmp_path / "out"))
    final = "".join(f.read_text() for f in (tmp_path / "out" / "final").glob("part*")).splitlines()
    assert {x for x in final if x[0] != ">"} == {"".join(t), "".join(u)} and all(x.startswith(">good__CL") for x in final[::2])
    names = [x for f in (tmp_path / "out" / "clusters").glob("*/*/part*") for x in f.read_text().splitlines() if x[0] == ">"]
    assert len(names) == len(set(names)) and ">r99" not in names and len(names) > 40
