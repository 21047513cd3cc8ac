"""Average linkage, column weights and the clustering plan as tables, against the kernels and brute force."""

import itertools
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlab.config import Config
from strandlab.functions import density, kernels
from strandlab.operators import linkage, samples, variants, wide


def table_of(spark, mats):
    """Nodes (sample_id, ord) and pairs of distance matrices by sample; numbers run 0, 2, 4, ..."""
    nodes = [(s, 2 * k) for s, d in mats.items() for k in range(len(d))]
    pairs = [(s, 2 * i, 2 * j, float(d[i, j])) for s, d in mats.items() for i, j in itertools.combinations(range(len(d)), 2)]
    return spark.createDataFrame(nodes, "sample_id string, ord long"), spark.createDataFrame(pairs, "sample_id string, ord_i long, ord_j long, d double")


def matrix(rng, n):
    d = rng.random((n, n))
    return np.triu(d, 1) + np.triu(d, 1).T


def test_linkage_and_cuts_equal_the_kernel(spark):
    rng = np.random.default_rng(3)
    mats = {f"s{n}": matrix(rng, n) for n in (1, 2, 3, 9, 25)} | {"line": np.abs(np.subtract.outer(x := 1.3 ** np.arange(7), x))}
    nodes, pairs = table_of(spark, mats)
    merges = linkage.average_linkage(nodes, pairs).cache()
    got = {}
    for r in merges.collect():
        got.setdefault(r.sample_id, []).append(r)
    bounds = [(s, k + 1, float(h)) for s in mats for k, h in enumerate((0.05, 0.31, 0.5, 7.0))]
    groups = {}
    for r in linkage.cut_tree(nodes, merges, spark.createDataFrame(bounds, "sample_id string, step int, height double")).collect():
        groups.setdefault((r.sample_id, r.step), {}).setdefault(r.cluster, set()).add(r.ord // 2)
    for s, d in mats.items():
        want = kernels.average_linkage(d)
        assert sorted(r.height for r in got.get(s, [])) == pytest.approx(sorted(m[2] for m in want), abs=1e-9)
        for k, h in enumerate((0.05, 0.31, 0.5, 7.0)):
            labels = kernels.cut(want, len(d), h)
            mine = groups[s, k + 1]
            assert {frozenset(v) for v in mine.values()} == {frozenset(np.flatnonzero(labels == g).tolist()) for g in set(labels.tolist())}
            assert all(c // 2 == min(v) for c, v in mine.items())
    assert linkage.average_linkage(nodes.limit(0), pairs.limit(0)).count() == 0


def planted(n=60, width=40, seed=1):
    rng = np.random.default_rng(seed)
    t = rng.integers(0, 4, width)
    x = np.tile(t, (n, 1))
    x[::2, (4, 21, 33)] = (x[::2, (4, 21, 33)] + 1) % 4
    wrong = rng.random(x.shape) < 0.02
    x[wrong] = (x[wrong] + rng.integers(1, 4, wrong.sum())) % 4
    return x, np.arange(n) % 2


def long(spark, xs):
    rows = [(s, f"r{i}", i, j + 1, kernels.SYMBOLS[int(x[i, j])]) for s, x in xs.items() for i in range(len(x)) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "sample_id string, read_id string, read_ord long, pos int, base string")


def test_column_weights_stand_out_at_variants(spark):
    x, _ = planted(40)
    features = spark.createDataFrame([("a", 5), ("a", 22), ("a", 34)], "sample_id string, pos int")
    rows = linkage.column_weights(long(spark, {"a": x, "b": x[:1]}), features).collect()
    w = {(r.sample_id, r.pos): r.weight for r in rows}
    assert len(w) == 80 and all(w["b", p] == 1.0 for p in range(1, 41))
    top = sorted(range(1, 41), key=lambda p: -w["a", p])[:3]
    assert set(top) == {5, 22, 34} and min(w["a", p] for p in top) > 5 * max(w["a", p] for p in range(1, 41) if p not in top)
    marks = np.zeros(40, bool)
    marks[[4, 21, 33]] = True
    theirs = kernels.column_weights(x, marks)
    assert set(np.argsort(-theirs)[:3] + 1) == {5, 22, 34}
    assert linkage.column_weights(long(spark, {"a": x}), features.limit(0)).count() == 40


def test_measures_equal_the_kernel(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([np.tile(rng.integers(0, 4, 12), (n, 1)) for n in (12, 14, 200, 9, 30)]).astype(np.int8)
    x[rng.random(x.shape) < 0.25] = 1
    x[:, 11], x[:240, 10] = 5, 5
    truth = np.repeat([1, 2, 3, 4, 0], [12, 14, 200, 9, 30])
    labels = {9: truth, 20: np.where(truth == 3, 1, 0), 30: np.zeros(len(x), int)}
    prob = rng.random(len(x))
    rows = [("a", m, i, int(v[i]), float(prob[i] * (v[i] > 0))) for m, v in labels.items() for i in range(len(x))]
    got = wide.measures(spark.createDataFrame(rows, "sample_id string, min_pts int, ord long, label int, probability double"), long(spark, {"a": x})).collect()
    assert len(got) == 3
    for r in got:
        want = kernels.measures(x, labels[r.min_pts], prob * (labels[r.min_pts] > 0), r.min_pts)
        assert {k: r[k] for k in want} == pytest.approx(want)


def test_clustering_as_tables_equals_the_loop(spark):
    x, _ = planted(40)
    rng = np.random.default_rng(9)
    d = kernels.hamming(x) + matrix(rng, 40)
    cfg = Config(grid=(5, 8, 12), extra_min_pts=(4, 3))
    small = kernels.hamming(x[:6]) + matrix(rng, 6)
    pairs = [(s, i, j, float(m[i, j])) for s, m in (("a", d), ("few", small)) for i, j in itertools.combinations(range(len(m)), 2)]
    out = wide.clusters(long(spark, {"a": x, "few": x[:6]}), spark.createDataFrame(pairs, "sample_id string, ord_i long, ord_j long, d double"), cfg)
    want = kernels.sweep(d, x, cfg)
    sweep = sorted(out.sweep.collect(), key=lambda r: r["rank"])
    assert [r.min_pts for r in sweep] == [r["min_pts"] for r in want]
    assert [r.objective for r in sweep] == pytest.approx([r["objective"] for r in want])
    c = density.cluster(d, want[0]["min_pts"], cfg.selection_epsilon)
    got = {(r.sample_id, r.read_ord): (r.cluster_id, r.is_outlier) for r in out.labels.collect()}
    flags = ((c.labels == 0) | (c.outlier >= cfg.outlier_threshold)).astype(int)
    assert got == {("a", i): (int(c.labels[i]), int(flags[i])) for i in range(40)} and c.labels.max() > 1


def test_mixed_pairs_equal_the_kernel(spark):
    rng = np.random.default_rng(8)
    z, w, y = (rng.random((15, 5)) < 0.4).astype(float), rng.random(5), rng.random((15, 3))
    want = kernels.mix(kernels.hybrid(z, w), kernels.euclid(y), z.sum(1))
    frame = spark.createDataFrame
    reads = frame([("a", i) for i in range(15)], "sample_id string, read_ord long")
    held = frame([("a", int(i), f"f{j}") for i, j in zip(*np.nonzero(z), strict=True)], "sample_id string, read_ord long, feature string")
    weights = frame([("a", f"f{j}", float(v)) for j, v in enumerate(w)], "sample_id string, feature string, w double")
    vectors = frame([("a", i, [float(v) for v in y[i]]) for i in range(15)], "sample_id string, read_ord long, vec array<double>")
    got = {(r.ord_i, r.ord_j): r.d for r in wide.mixed_pairs(reads, held, weights, vectors).collect()}
    assert len(got) == 105 and all(abs(v - want[k]) < 1e-9 for k, v in got.items())


def exact(k, n, p):
    p = Fraction(p)
    return float(sum(math.comb(n, x) * p**x * (1 - p) ** (n - x) for x in range(k, n + 1)))


def test_binomial_tail(spark):
    rng = np.random.default_rng(6)
    cases = [(k, n, float(p)) for n in (1, 2, 5, 16, 40) for k in range(n + 1) for p in (5e-4, 0.03, 0.25, 0.9)]
    cases += [(int(rng.integers(0, 301)), 300, float(rng.choice([5e-4, 0.01, 0.25]))) for _ in range(10)]
    got = spark.createDataFrame(cases, "k long, n long, p double").select(variants.binomial_survival(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect()
    assert max(abs(r.s - exact(*c)) for r, c in zip(got, cases, strict=True)) < 1e-9


def tail(k, n, p):
    """The sum in logarithms over the terms that count."""
    x = np.arange(k, min(n, k + 200_000) + 1)
    terms = np.array([math.lgamma(n + 1) - math.lgamma(v + 1) - math.lgamma(n - v + 1) for v in x]) + x * math.log(p) + (n - x) * math.log1p(-p)
    return math.fsum(np.exp(terms))


def test_binomial_tail_of_large_samples(spark):
    cases = [(k, n, p) for n in (10_000, 1_000_000) for p in (5e-4, 0.01, 0.25) for k in (int(n * p) - int(2 * (n * p) ** 0.5), int(n * p) + 1, int(n * p) + int(3 * (n * p) ** 0.5), int(n * (p + 0.01)))]
    got = spark.createDataFrame(cases, "k long, n long, p double").select(variants.binomial_survival(F.col("k"), F.col("n"), F.col("p")).alias("s")).collect()
    for r, c in zip(got, cases, strict=True):
        assert abs(r.s - tail(*c)) < 3e-8, c  # the sum itself loses digits to factorials of a million


def test_functions_as_parameters(spark):
    stats = spark.createDataFrame([("a", k, 0.0, 10, 0.1 * k) for k in range(5)], "sample_id string, pos int, gap_frac double, depth long, nonmajor double")
    assert [r.bg for r in variants.background(stats, Config(window=1), F.max).orderBy("pos").collect()] == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.4])
    with pytest.raises(TypeError, match="number"):
        variants.background(stats, fun=lambda c: F.max(c.cast("string")))
    bases = spark.createDataFrame([("a", "r", 1, "A", 30), ("a", "r", 2, "-", 0)], "sample_id string, read_id string, pos int, base string, q int")
    weights = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0)], "sample_id string, pos int, weight double")
    got = {r.feature: r.value for r in variants.one_hot(bases, weights, lambda base, q: F.when(base == "-", 0.5).otherwise(1.0)).collect()}
    assert got == {"A_0": 2.0, "-_1": 1.5}
    with pytest.raises(TypeError, match="number"):
        variants.one_hot(bases, weights, lambda base, q: base)


def test_samples_beyond_a_worker_are_errors(spark, monkeypatch):
    monkeypatch.setattr(samples, "MAX_READS", 15)
    rows = spark.createDataFrame([("s", f"r{k}", k, "ACGT" * 5, "I" * 20) for k in range(16)], "sample_id string, read_id string, read_ord long, aln_seq string, aln_qual string")
    got = samples.guarded_clusters(rows, spark.createDataFrame([], "sample_id string, pos int, base string, weight double")).collect()
    assert len(got) == 1 and got[0].error.startswith("MemoryError: 16 reads")
