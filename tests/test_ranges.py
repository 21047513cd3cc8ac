"""Byte ranges of FASTQ and FASTA files: every split gives the same records."""

import gzip
import io

from strandlab.sources import files, ranges

#: Quality lines that begin with '@' or '+', a '+' line with text, an empty read, and no line break at the end.
FASTQ = "@r1 x\nACGT\n+\n@III\n@r2\nac\n+r2\n+I\n@r3\nGG\n+\n@@\n@r4\n\n+\n\n@r5\nTTT\n+@r5\n@+@\n@r6\nA\n+\nI"
FASTA = "\n>a x\nAC\nGT\n>b\n\n>c\nA\n>d\nC\nG\n\nT"


def cuts(data, records, bounds):
    out = []
    for a, b in zip([0, *bounds], [*bounds, len(data)], strict=True):
        out += records(io.BufferedReader(io.BytesIO(data)), a, b)
    return out


def test_every_split_gives_the_same_records():
    for text, records, n in ((FASTQ, ranges.fastq_records, 6), (FASTQ.replace("\n", "\r\n"), ranges.fastq_records, 6), (FASTA, ranges.fasta_records, 4)):
        data = text.encode()
        whole = cuts(data, records, [])
        assert len(whole) == n
        for a in range(1, len(data)):
            assert cuts(data, records, [a]) == whole, a
        for size in (1, 2, 3, 5, 11):
            assert cuts(data, records, list(range(size, len(data), size))) == whole, size


def test_cut_off_record_is_none():
    data = b"@r1\nAC\n+\nII\n@r2\nACGT\n+"
    assert cuts(data, ranges.fastq_records, []) == [("r1", "AC", "II")]
    assert cuts(b"", ranges.fastq_records, []) == [] and cuts(b"\n\n", ranges.fasta_records, []) == []


def test_ranges_run_as_tasks_and_number_reads(spark, tmp_path):
    text = "".join(f"@r{k}\n{'ACGT' * (k % 9)}\n+\n{'@+I!' * (k % 9)}\n" for k in range(500))
    (tmp_path / "a_refined.fastq").write_text(text)
    with gzip.open(tmp_path / "b_refined.fastq.gz", "wb") as f:
        f.write(text.encode())
    (tmp_path / "c_refined.fastq").write_text("")
    got = files.read_fastq(spark, str(tmp_path), split=1000)
    assert got.rdd.getNumPartitions() == -(-len(text) // 1000) + 1
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted((s, f"r{k}", k, "ACGT" * (k % 9), "@+I!" * (k % 9)) for s in "ab" for k in range(500))
    one = files.read_fastq(spark, str(tmp_path))
    assert sorted(map(tuple, one.collect())) == rows
    (tmp_path / "d_refined.fasta").write_text(">x y\nac\ngt\n" * 100)
    fasta = files.read_fasta(spark, str(tmp_path), split=64).collect()
    assert sorted(map(tuple, fasta)) == [("d", "x y", k, "ACGT") for k in range(100)]


def test_other_stores_are_read_whole(spark, tmp_path):
    (tmp_path / "a_refined.fastq").write_text("@r1\nAC\n+\n@I\n")
    assert not files.splittable(spark, "viewfs://store/x") and files.splittable(spark, str(tmp_path))
    assert list(map(tuple, files._whole_fastq(spark, str(tmp_path), "*.fastq", files.DEFAULT).collect())) == [("a", "r1", 0, "AC", "@I")]
