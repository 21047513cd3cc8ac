"""Pair distances against brute force, and where sums of weights in another order would show."""

import random

import numpy as np

from strandlab.operators import distances, forest


def test_equal_sets_of_features_are_at_distance_0(spark):
    rng = random.Random(1)
    weights = {f: 10 ** rng.uniform(-6, 3) for f in "abcdefgh"}
    rows = []
    for k in range(40):
        order = list("abcdefgh")
        rng.shuffle(order)
        rows += [("s", k, f, weights[f]) for f in order]
    rng.shuffle(rows)
    feats = spark.createDataFrame(rows, "sample_id string, read_ord long, feature string, w double").repartition(7)
    reads = spark.createDataFrame([("s", k) for k in range(41)], "sample_id string, read_ord long")
    got = {(r.ord_i, r.ord_j): r.d for r in distances.jaccard_pairs(reads, feats).collect()}
    # not 1e-16, which as a sample's median would blow up its scaled distances
    assert len(got) == 41 * 40 // 2 and {d for (_, j), d in got.items() if j < 40} == {0.0} and {d for (_, j), d in got.items() if j == 40} == {1.0}


def test_jaccard_joins_reads_alone(spark):
    feats = spark.createDataFrame([("s", 1, "a", 1.0), ("s", 1, "b", 2.0), ("s", 2, "b", 2.0)], "sample_id string, read_ord long, feature string, w double")
    reads = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "sample_id string, read_ord long")
    for out in (distances.jaccard_pairs(reads, feats), distances.signed_cosine(reads, feats.drop("w"), feats.select("sample_id", "feature", "w").distinct())):
        assert "ord_j" not in "".join(x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x and "=" in x and "<" not in x)
    assert [(r.ord_i, r.ord_j, round(r.d, 9)) for r in distances.jaccard_pairs(reads, feats).collect()] == [(1, 2, round(1 / 3, 9))]


def test_euclid_tiles(spark, monkeypatch):
    monkeypatch.setattr(forest, "TILE", 40)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(90, 3)).astype("float32")
    rows = [(k % 2, k, [float(x) for x in v[k]]) for k in range(90)] + [(None, 500, [0.0] * 3), (7, 501, [0.0] * 3)]
    df = spark.createDataFrame(rows, "label int, vec_id long, embedding array<float>")
    out = distances.euclid_pairs(df, "vec_id", "embedding", "label")
    assert "mapInPandas" in out._jdf.queryExecution().toString() or "MapInPandas" in out._jdf.queryExecution().toString()
    got = {(r.label, r.ord_i, r.ord_j): r.d for r in out.collect()}
    want = {(i % 2, i, j): np.linalg.norm(v[i].astype(float) - v[j]) for i in range(90) for j in range(i + 2, 90, 2)}
    assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()))
