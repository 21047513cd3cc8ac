"""Runs, counts and distances read off batches of reads, against brute force over strings."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strandlab.functions import blocks
from strandlab.operators import cells, consensus, distances, masking, quality, variants
from strandlab.plans import catalog

READ = "sample_id string, read_id string, read_ord long, cluster string, aln_seq string, aln_qual string"


def drawn(seed, n=200, symbols="AAACG--NRa"):
    rng = random.Random(seed)
    return [None, "", "-", *("".join(rng.choice(symbols) for _ in range(rng.randrange(1, 40))) for _ in range(n))]


def homopolymer(s, least):
    hit = set()
    for base in "ACGT":
        for m in re.finditer(f"{base}[{base}-]*", s):
            if m.group().count(base) >= least:
                hit |= set(range(*m.span()))
    return hit


def spans(s, unit, times, gaps):
    at = [k for k, c in enumerate(s) if c != "-"]
    d, hit = "".join(s[k] for k in at), set()
    for i in range(len(d) - unit * times + 1):
        w = d[i : i + unit * times]
        if w == w[:unit] * times and re.fullmatch("[ACGT]+", w):
            hit |= set(range(at[i], at[i + unit * times - 1] + 1)) if gaps else set(at[i : i + unit * times])
    return hit


def rows(hit):
    return [set(np.flatnonzero(r).tolist()) for r in hit]


def test_runs():
    texts = drawn(1)
    x, own = blocks.block(pa.array(["junk", *texts], pa.string())[1:])
    assert rows(blocks.homopolymers(x, 4) & own) == [homopolymer(s or "", 4) for s in texts]
    texts = drawn(2, 400, "AC-ACACN")
    x, _ = blocks.block(pa.array(texts, pa.string()))
    for (unit, times), gaps in itertools.product(((2, 3), (3, 2), (1, 5)), (False, True)):
        assert rows(blocks.repeats(x, unit, times, gaps)) == [spans(s or "", unit, times, gaps) for s in texts]


def test_strings_and_wide_characters():
    texts = ["", "AC-G", "é-ß", "😀A"]
    x, own = blocks.block(pa.array(texts))
    assert blocks.strings(x, own).to_pylist() == texts and [r.sum() for r in own] == [0, 4, 3, 2]
    assert blocks.picked(pa.array(["ACGT", "AC", ""]), pa.array([[2, 4], [2, 3], [1]], pa.list_(pa.int32()))).to_pylist() == ["CT", "C", ""]
    assert blocks.regapped(pa.array(["-A-CG", "AC", "--"]), pa.array(["IJK", "I", "Q"])).to_pylist() == ["!I!JK", "I", "!!"]


def test_mismatches(spark):
    pairs = [(a, b) for a, b in zip(drawn(3, 100), drawn(4, 100)) if a is None or b is None or len(a) <= len(b)] + [("ACR-", "ACA-"), ("NN", "A-"), ("aa", "aa")]
    codes = "ACMGRSVTWYHKDBN"
    sets = lambda c: codes.find(c) + 1

    def want(a, b, strict):
        if a is None or b is None:
            return None
        same = lambda x, y: (x == y == "-") or ("-" not in (x, y) and ((x == y and x in "ACGT") if strict else bool(sets(x) & sets(y))))
        return sum(not same(x, y) for x, y in zip(a, b))

    df = spark.createDataFrame(pairs, "a string, b string")
    for strict in (True, False):
        got = [r.d for r in df.select(distances.mismatches(F.col("a"), F.col("b"), strict).alias("d")).collect()]
        assert got == [want(a, b, strict) for a, b in pairs]


def test_tally_and_cells_at(spark):
    reads = [(s, f"{s}{k}", k, None if k % 3 else "c", t, "I" * len(t or "")) for s in "ab" for k, t in enumerate(drawn(ord(s), 30))]
    df = spark.createDataFrame(reads, READ).repartition(3)
    got = {(r.sample_id, r.cluster, r.pos): (r.n_a, r.n_gap, r.n_all) for r in variants.read_counts(df, "cluster").collect()}
    want = {}
    for s, _, _, c, t, _ in reads:
        for p, b in enumerate(t or "", 1):
            a, g, n = want.get((s, c, p), (0, 0, 0))
            want[s, c, p] = (a + (b == "A"), g + (b == "-"), n + 1)
    assert got == want
    at = spark.createDataFrame([("a", 2), ("a", 2), ("a", 30)], "sample_id string, pos int")
    got = sorted((r.read_id, r.pos, r.base, r.q) for r in cells.cells_at(df, at).collect())
    assert got == sorted((i, p, t[p - 1], 40) for s, i, _, _, t, _ in reads for p in (2, 30) if s == "a" and t and len(t) >= p)


def test_best_reads_of_columns_with_few_votes(spark):
    reads = [("s", f"r{k}", k, "1", "".join(random.Random(k).choice("ACGT-N") for _ in range(6)), "".join(random.Random(-k).choice("#+I") for _ in range(6))) for k in range(5)]
    df = spark.createDataFrame(reads, READ)
    long = [(s, c, i, o, p, b, ord(q) - 33) for s, i, o, c, t, u in reads for p, (b, q) in enumerate(zip(t, u), 1)]
    bases = spark.createDataFrame(long, "sample_id string, cluster string, read_id string, read_ord long, pos int, base string, q int")
    both = [sorted(map(str, consensus.votes(b).collect())) for b in (consensus.read_ballots(df), consensus.ballots(bases))]
    assert both[0] == both[1] and consensus.ballots(bases).where("best is not null").count()


def test_no_row_per_cell_is_shuffled(spark, sf):
    """A cell's row, with its keys, took 70 times a read's room in the shuffles."""
    for name in ("consensus", "merge_mask", "iupac", "trimmed_alignment", "gap_islands", "repeat_mask", "homopolymer_flags", "col_counts", "ambiguity_table", "header_parse"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "posexplode" not in plan and not re.search(r"windowspecdefinition\([^)]*read_id", plan), name


def test_qualities_within_the_row(spark):
    texts = ["", "I", "5I!", "~~"]
    got = spark.createDataFrame([(t,) for t in texts], "q string").select(quality.mean_q(F.col("q")).alias("m")).collect()
    error = lambda t: sum(10 ** ((33 - ord(c)) / 10) for c in t) / max(1, len(t))
    assert np.allclose([r.m for r in got], [-10 * np.log10(max(1e-10, error(t))) for t in texts])


def test_trim_drops_what_has_no_column_left(spark):
    reads = spark.createDataFrame([("s", "a", 0, "c", "ACGT", "IJKL"), ("t", "b", 1, "c", "AC", "II")], READ)
    mask = spark.createDataFrame([("s", 1, True), ("s", 2, False), ("s", 3, True), ("s", 4, False), ("t", 1, True), ("t", 2, True)], "sample_id string, pos int, masked boolean")
    assert [(r.read_id, r.aln_seq, r.aln_qual) for r in masking.trim(reads, mask).collect()] == [("a", "CT", "JL")]
