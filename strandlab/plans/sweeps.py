"""Queries on the sweep's replay, the hybrid distance, core distances and guards, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlab.operators import forest, hybrid, linkage, replay
from strandlab.operators import quality as q
from strandlab.operators import variants as v
from strandlab.plans import columns, denoise, distances, fixture
from strandlab.plans.catalog import query
from strandlab.plans.distances import UNIT
from strandlab.plans.reads import THRESHOLDS, r6

#: A table of evaluations made from ``part``: brands are samples of 51 to 95 reads, sizes are parameters. By its number a brand has
#: no clusters, no ambiguity, or ambiguity with noise that grows with the parameter, so that every rule finds its case.
EVALUATED = """ev AS (
  SELECT p_brand AS sample_id, p_size AS min_pts, CASE k % 5 WHEN 0 THEN 0 WHEN 2 THEN 2 ELSE count(*) % 3 + 1 END AS n_clusters, max(p_partkey) % 40 + 1 AS max_size, sum(p_partkey) % 90 + 5 AS in_cluster,
    CASE WHEN k % 5 = 2 THEN p_size / 100 ELSE avg(p_retailprice) / 3000 END AS noise_frac, min(p_retailprice) / 3000 AS prob_mean, max(p_retailprice) / 3000 AS stability_mean,
    CASE WHEN k % 5 = 1 THEN 0.0 ELSE (sum(p_partkey) % 7)::DOUBLE END AS ambig_bases, CASE WHEN k % 5 = 1 THEN 0.0 ELSE (max(p_partkey) % 5)::DOUBLE END AS ambig_bases_raw
  FROM (SELECT *, substr(p_brand, 7)::INT AS k FROM part) GROUP BY p_brand, p_size, k),
sz AS (SELECT DISTINCT sample_id, 40 + substr(sample_id, 7)::INT AS n FROM ev)"""
MEASURES = ", ".join(replay.MEASURES)


def _scored(source: str, name: str) -> str:
    """CTE ``name``: the rows of ``source`` with their objective, scaled over these rows."""
    return f"""{name}_c AS (SELECT *, 0.5 * {UNIT("ambig_bases", 0)} + 0.5 * {UNIT("ambig_bases_raw", 0)} AS c, max_size / greatest(in_cluster, 10 * min_pts) / ln(1 + min_pts) AS par FROM {source} WINDOW w AS (PARTITION BY sample_id)),
{name} AS (SELECT * EXCLUDE (c, par), CASE WHEN n_clusters > 0 THEN 1 ELSE 0.5 END * (0.1 * {UNIT("(1 - noise_frac)", 1)} + 0.05 * {UNIT("prob_mean", 1)} + 0.05 * {UNIT("stability_mean", 1)} + 0.25 * {UNIT("par", 1)}
  + 0.55 * CASE WHEN c BETWEEN 0.5 AND 0.6 THEN least(1 - pow(c, 0.6), 0.8) WHEN c >= 0.35 AND c < 0.5 THEN least(1 - pow(c, 0.6), 0.9) ELSE 1 - pow(c, 0.6) END) AS objective FROM {name}_c WINDOW w AS (PARTITION BY sample_id))"""


SEEN = f"""{EVALUATED},
g AS (SELECT ev.*, n, min_pts IN (9, 12, 15, 18, 21, 24, 30, 35, 40, 50, 60) AND min_pts <= n - 1 AS grid FROM ev JOIN sz USING (sample_id)),
p AS (SELECT *, count(*) FILTER (grid) OVER (PARTITION BY sample_id) AS size, row_number() OVER (PARTITION BY sample_id ORDER BY grid DESC, min_pts) - 1 AS place FROM g),
f AS (SELECT *, grid AND (size < 3 OR place BETWEEN (size + 1) // 2 - 2 AND (size + 1) // 2) AS first FROM p),
a AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY grid DESC, first DESC, min_pts) AS step,
  coalesce(size >= 3 AND min(n_clusters) FILTER (first) OVER s = max(n_clusters) FILTER (first) OVER s AND min(n_clusters) FILTER (first) OVER s > 0 AND max(ambig_bases_raw) FILTER (first) OVER s = 0, false) AS agree FROM f WINDOW s AS (PARTITION BY sample_id)),
e AS (SELECT *, grid AND NOT first AND 2 * step >= size AND max(n_clusters) OVER (PARTITION BY sample_id ORDER BY step) = 0 AS ends FROM a),
h AS (SELECT *, grid AND (first OR NOT agree) AND coalesce(count(*) FILTER (ends) OVER (PARTITION BY sample_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS seen FROM e),
s1 AS (SELECT * FROM h WHERE seen), {_scored("s1", "o1")},
b1 AS (SELECT sample_id, first(struct_pack(nc := n_clusters, raw := ambig_bases_raw) ORDER BY objective DESC, step) AS best, max(step) AS last, min(min_pts) AS least FROM o1 GROUP BY ALL),
t1 AS (SELECT sample_id, first(struct_pack(m := min_pts, nc := n_clusters, amb := ambig_bases) ORDER BY objective DESC, step) AS top, min(min_pts) AS edge,
  quantile_cont(ambig_bases, 0.5) FILTER (ambig_bases > 0) AS mid_ambig, quantile_cont(n_clusters, 0.5) AS mid_clusters FROM o1 WHERE n_clusters > 0 GROUP BY ALL),
r AS (SELECT h.*, last, top, CASE
    WHEN top IS NULL THEN CASE WHEN min_pts >= greatest(3, least // 2) AND min_pts < least THEN 1 END
    WHEN NOT (best.nc > 0 AND best.raw = 0) AND top.m = edge AND top.amb >= mid_ambig AND top.nc <= mid_clusters AND min_pts >= 3 AND min_pts < top.m THEN CASE WHEN min_pts IN (3, 4, 5) THEN 1 WHEN min_pts = 7 THEN 2 END END AS wave
  FROM h JOIN b1 USING (sample_id) LEFT JOIN t1 USING (sample_id) WHERE NOT seen),
q AS (SELECT * EXCLUDE (step), last + row_number() OVER (PARTITION BY sample_id ORDER BY wave, min_pts) AS step FROM r WHERE wave IS NOT NULL),
s2 AS (SELECT sample_id, min_pts, n, grid, step, {MEASURES} FROM s1 UNION ALL SELECT sample_id, min_pts, n, grid, step, {MEASURES} FROM q WHERE wave = 1), {_scored("s2", "o2")},
t2 AS (SELECT sample_id, first(ambig_bases ORDER BY objective DESC, step) FILTER (n_clusters > 0) AS now, max(step) AS upto FROM o2 GROUP BY ALL),
s3 AS (SELECT * FROM s2 UNION ALL SELECT q.sample_id, min_pts, n, grid, step, {MEASURES} FROM q JOIN t2 USING (sample_id) WHERE wave = 2 AND upto > last AND now >= top.amb), {_scored("s3", "o3")},
l AS (SELECT *, max(max_size) FILTER (grid AND n_clusters > 0) OVER s AS large, min(min_pts) FILTER (grid) OVER s AS low, min(objective) OVER s - 1 AS worst FROM o3 WINDOW s AS (PARTITION BY sample_id)),
z AS (SELECT * EXCLUDE (objective), CASE WHEN min_pts < low AND coalesce(max_size < greatest(CASE WHEN large >= 0.1 * n THEN 0.1 * n END, CASE WHEN large >= 6 THEN 6.0 END), false) THEN worst ELSE objective END AS objective FROM l)"""


def evaluated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The planted evaluations and (sample_id, n)."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").withColumn("k", F.substring("p_brand", 7, 9).cast("int") % 5)
    p = p.groupBy(F.col("p_brand").alias("sample_id"), F.col("p_size").alias("min_pts"), "k")
    case = lambda k, a, b: F.when(F.col("k") == k, a).otherwise(b)
    s = p.agg(
        case(0, 0, case(2, 2, F.count(F.lit(1)) % 3 + 1)).alias("n_clusters"), (F.max("p_partkey") % 40 + 1).alias("max_size"), (F.sum("p_partkey") % 90 + 5).alias("in_cluster"),
        case(2, F.col("min_pts") / 100, F.avg("p_retailprice") / 3000).alias("noise_frac"), (F.min("p_retailprice") / 3000).alias("prob_mean"), (F.max("p_retailprice") / 3000).alias("stability_mean"),
        case(1, 0.0, (F.sum("p_partkey") % 7).cast("double")).alias("ambig_bases"), case(1, 0.0, (F.max("p_partkey") % 5).cast("double")).alias("ambig_bases_raw"),
    ).drop("k")
    return s, s.select("sample_id", (40 + F.substring("sample_id", 7, 9).cast("int")).alias("n")).distinct()


@query("sweep_replay", f"WITH {SEEN} SELECT sample_id, min_pts, step::INT AS step, round(objective, 6) AS objective, (row_number() OVER (PARTITION BY sample_id ORDER BY objective DESC, min_pts))::INT AS rank FROM z")
def sweep_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(replay.replay(*evaluated(spark, sf_dir)).select("sample_id", "min_pts", "step", "objective", "rank"), "objective")


SHAPED = lambda m, r, c: f"CASE WHEN deficit > 0 THEN greatest(pow({r}, 1 / (1 + deficit)), pow({c}[1], 1 / (1 + deficit)) + (pow({c}[-1], 1 / (1 + deficit)) - pow({c}[1], 1 / (1 + deficit))) * (len_ - 1) / len_) ELSE {m} END"


@query(
    "hybrid_pairs",
    f"""WITH {distances.RF},
    fw AS (SELECT DISTINCT sample_id, feature, w FROM rf),
    nw AS (SELECT sample_id, feature, CASE WHEN sum(w) OVER s > 0 THEN w / sum(w) OVER s ELSE 1 / count(*) OVER s END AS w FROM fw WINDOW s AS (PARTITION BY sample_id)),
    nn AS (SELECT sample_id, count(*) AS n FROM reads GROUP BY ALL),
    hv AS (SELECT rf.sample_id, rf.read_ord, rf.feature, nw.w FROM rf JOIN nw ON nw.sample_id = rf.sample_id AND nw.feature = rf.feature),
    fk AS (SELECT sample_id, feature, count(*) / any_value(n) AS raw FROM hv JOIN nn USING (sample_id) GROUP BY ALL),
    fp AS (SELECT *, greatest(1e-12, least(raw, 1 - 1e-12)) AS p FROM fk),
    fq AS (SELECT sample_id, quantile_cont(p, 0.25) AS q1, quantile_cont(p, 0.75) AS q3 FROM fp GROUP BY ALL),
    fm AS (SELECT sample_id, avg(-(p * log2(p) + (1 - p) * log2(1 - p))) AS entropy, avg((p BETWEEN q1 AND q3)::INT) AS middle, 1 - quantile_cont(raw, 0.5) AS spread FROM fp JOIN fq USING (sample_id) GROUP BY ALL),
    dense AS (SELECT r.sample_id, r.read_ord, nw.feature, nw.w, (hv.w IS NOT NULL)::INT AS x FROM reads r JOIN nw ON nw.sample_id = r.sample_id LEFT JOIN hv ON hv.sample_id = r.sample_id AND hv.read_ord = r.read_ord AND hv.feature = nw.feature),
    cen AS (SELECT *, x - avg(x) OVER (PARTITION BY sample_id, feature) AS c FROM dense),
    one AS (SELECT sample_id, read_ord, sum(w * x) AS load, sum(w * c * c) AS nrm FROM cen GROUP BY ALL),
    two AS (SELECT a.sample_id, a.read_ord AS ord_i, b.read_ord AS ord_j, sum(a.w * a.x * b.x) AS inter, sum(a.w * a.c * b.c) AS dot FROM cen a JOIN cen b ON a.sample_id = b.sample_id AND a.feature = b.feature AND a.read_ord < b.read_ord GROUP BY ALL),
    pp AS (SELECT two.sample_id, ord_i, ord_j, i.load AS load_i, j.load AS load_j, i.load + j.load - inter AS u, CASE WHEN i.load + j.load - inter > 0 THEN 1 - inter / (i.load + j.load - inter) ELSE 1 END AS jac,
      CASE WHEN i.nrm > 1e-13 AND j.nrm > 1e-13 THEN 1 - dot / sqrt(i.nrm * j.nrm) ELSE 1 END AS cos
      FROM two JOIN one i ON i.sample_id = two.sample_id AND i.read_ord = ord_i JOIN one j ON j.sample_id = two.sample_id AND j.read_ord = ord_j),
    er AS (SELECT *, cume_dist() OVER (PARTITION BY sample_id ORDER BY round(jac, 9)) AS e FROM pp),
    dg AS (SELECT sample_id, quantile_cont(e, 0.5) * (1 - (quantile_cont(e, 0.75) - quantile_cont(e, 0.25))) AS deficit, avg(greatest(0, cos - jac)) AS fs, avg(greatest(0, jac - cos)) AS fj, count(*) AS len_ FROM er GROUP BY ALL),
    tq AS (SELECT sample_id, quantile_cont(u, 0.5) AS tau FROM (SELECT sample_id, u FROM pp UNION ALL SELECT sample_id, u FROM pp UNION ALL SELECT sample_id, load FROM one) WHERE u > 0 GROUP BY ALL),
    th AS (SELECT sample_id, quantile_cont(load, 0.25) AS thin FROM one WHERE load > 0 GROUP BY ALL),
    m0 AS (SELECT dg.sample_id, deficit, len_, least(0.5, greatest(0, entropy * deficit * (1 - middle))) AS w_pos, CASE WHEN fs + fj > 0 THEN fs / (fs + fj) ELSE 0 END AS adv, spread, coalesce(tau, 1) AS tau, thin FROM dg JOIN fm USING (sample_id) LEFT JOIN tq USING (sample_id) LEFT JOIN th USING (sample_id)),
    m1 AS (SELECT *, (1 - w_pos) * adv * 0.5 AS w_sig, 1 - w_pos - (1 - w_pos) * adv * 0.5 AS w_fus FROM m0),
    x0 AS (SELECT pp.*, m1.* EXCLUDE (sample_id), u / (u + tau) AS g, sqrt(coalesce(least(1, load_i / thin), 0) * coalesce(least(1, load_j / thin), 0)) AS gate FROM pp JOIN m1 ON m1.sample_id = pp.sample_id),
    x1 AS (SELECT *, least(w_fus, 0.5 * adv * spread * (1 - g) * greatest(0, cos - jac) / greatest(1e-12, abs(cos) + abs(jac)) * (1 - w_pos)) AS boost FROM x0),
    x2 AS (SELECT *, (w_fus + w_pos) * jac + w_sig * cos AS v1, (0.5 + 0.5 * gate) * (g * ((w_fus - boost + w_pos) * jac + (w_sig + boost) * cos) + (1 - g) * (w_pos * jac + (1 - w_pos) * cos)) AS v2 FROM x1),
    x3 AS (SELECT *, cume_dist() OVER (PARTITION BY sample_id ORDER BY round(v1, 9)) AS r1, cume_dist() OVER (PARTITION BY sample_id ORDER BY round(v2, 9)) AS r2 FROM x2),
    x4 AS (SELECT sample_id, min(r1, 2) AS c1, min(r2, 2) AS c2 FROM x3 GROUP BY ALL),
    x5 AS (SELECT *, least(1, greatest(0, 0.5 * (1 - g) + 0.5 * (1 - gate))) AS alpha FROM x3 JOIN x4 USING (sample_id)),
    al AS (SELECT a.sample_id, a.read_ord AS ord_i, b.read_ord AS ord_j FROM reads a JOIN reads b ON a.sample_id = b.sample_id AND a.read_ord < b.read_ord)
    SELECT sample_id, ord_i, ord_j, round(greatest(0, coalesce(alpha * {SHAPED("v1", "r1", "c1")} + (1 - alpha) * {SHAPED("v2", "r2", "c2")}, 0)), 6) AS d FROM al LEFT JOIN x5 USING (sample_id, ord_i, ord_j)""",
)
def hybrid_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = distances.read_features(spark, sf_dir)
    return r6(hybrid.hybrid_pairs(distances.small(spark, sf_dir), f.drop("w"), f.select("sample_id", "feature", "w").distinct()), "d")


@query(
    "core_distances",
    """WITH p AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, sqrt(list_sum(list_transform(range(1, 65), lambda k: (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE) * (a.embedding[k]::DOUBLE - b.embedding[k]::DOUBLE)))) AS d
      FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
    q AS (SELECT label, i AS ord, d FROM p UNION ALL SELECT label, j, d FROM p)
    SELECT label::VARCHAR AS sample_id, ord, round(d, 5) AS core FROM q QUALIFY row_number() OVER (PARTITION BY label, ord ORDER BY d) = 8""",
)
def core_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the embeddings of a label, in tiles."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = e.select(F.col("label").cast("string").alias("sample_id"), F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))
    return r6(forest.tile_core_distances(rows, 9), "core", digits=5)


@query(
    "guard_errors",
    f"""{THRESHOLDS}, k AS (SELECT sample_id, total, count(*) FILTER (kept) AS n FROM t GROUP BY ALL)
    SELECT sample_id, CASE WHEN total < 6 THEN 'quality filter' ELSE 'clustering' END AS stage, concat('too few reads: ', CASE WHEN total < 6 THEN total ELSE n END) AS message FROM k WHERE total < 6 OR n < 10""",
)
def guard_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The errors of the customers' samples that the guards of the first stages stop."""
    reads = distances.small(spark, sf_dir)
    kept = q.mad_filter(reads.select("sample_id", "read_id", q.accuracy(F.col("aln_qual")).alias("acc")))
    return denoise.too_few(denoise.sizes_of(reads), 6, "quality filter").unionAll(denoise.too_few(denoise.sizes_of(kept), 10, "clustering"))


@query(
    "ambiguity_table",
    f"""WITH {fixture.sql(8)}, lb AS (SELECT DISTINCT sample_id, read_id, CASE truth WHEN 'F' THEN '1' WHEN 'O' THEN '2' ELSE '0' END AS cluster FROM bases),
    kp AS (SELECT sample_id, pos FROM bases GROUP BY ALL HAVING avg((base = '-')::INT) <= 0.9),
    ct AS (SELECT sample_id, cluster, pos, list_sort([count(*) FILTER (base = 'A'), count(*) FILTER (base = 'C'), count(*) FILTER (base = 'G'), count(*) FILTER (base = 'T')], 'DESC') AS n FROM bases JOIN lb USING (sample_id, read_id) JOIN kp USING (sample_id, pos) WHERE cluster <> '0' GROUP BY ALL),
    st AS (SELECT sample_id, cluster, count(*) FILTER (list_sum(n) >= 10 AND n[2] >= 5 AND n[2] / list_sum(n) >= 0.25) AS ambig_sites FROM ct GROUP BY ALL)
    SELECT sample_id, cluster, count(*) AS n_reads, CASE WHEN cluster <> '0' THEN any_value(ambig_sites) END AS ambig_sites FROM lb LEFT JOIN st USING (sample_id, cluster) GROUP BY sample_id, cluster""",
)
def ambiguity_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of planted clusters: orders in process count as noise."""
    reads = fixture.aligned(spark, sf_dir, 8)
    label = F.when(F.col("truth") == "F", "1").when(F.col("truth") == "O", "2").otherwise("0")
    return v.ambiguity_table(reads, reads.select("sample_id", "read_id", label.alias("cluster")))


@query(
    "mean_background",
    f"WITH {fixture.sql(8)}, {columns.STATS}, k AS (SELECT * FROM stats WHERE gap_frac <= 0.9 AND depth > 0) SELECT sample_id, pos, round(avg(nonmajor) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) AS bg FROM k",
)
def mean_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With another aggregate than the median, and a narrower window."""
    return r6(v.background(columns.stats(spark, sf_dir), v.Config(window=20), F.avg).select("sample_id", "pos", "bg"), "bg")


PROBS = ", ".join(str((k / linkage.STEPS) ** linkage.SKEW) for k in range(linkage.STEPS + 1))


@query(
    "step_bounds",
    f"""WITH m AS (SELECT (o_custkey % 8)::VARCHAR AS sample_id, o_orderkey AS ord, floor(o_totalprice / 50)::DOUBLE AS height FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY height, ord) >= greatest(7, 0.1 * (count(*) OVER (PARTITION BY sample_id) + 1)) AS late FROM m),
    o AS (SELECT sample_id, max(height) AS top, count(*) FILTER (late) AS n_late, quantile_cont(height, [{PROBS}]) FILTER (late) AS q FROM r GROUP BY ALL),
    u AS (SELECT sample_id, top, n_late, unnest(range(len(q))) AS k, unnest(q) AS height FROM o),
    a AS (SELECT *, height - lag(height) OVER (PARTITION BY sample_id ORDER BY k) > 0.01 * top AS apart FROM u),
    t AS (SELECT sample_id, k, height FROM a WHERE apart AND n_late >= 2),
    b AS (SELECT * FROM t UNION ALL SELECT sample_id, 1, top FROM o WHERE sample_id NOT IN (SELECT sample_id FROM t))
    SELECT sample_id, (row_number() OVER (PARTITION BY sample_id ORDER BY k))::INT AS step, round(height, 6) AS height FROM b""",
)
def step_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of merge heights made from the orders' prices, at a width of 700 columns."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    merges = o.select((F.col("o_custkey") % 8).cast("string").alias("sample_id"), F.lit(0).alias("into"), F.col("o_orderkey").alias("ord"), F.floor(F.col("o_totalprice") / 50).cast("double").alias("height"))
    shape = merges.groupBy("sample_id").agg((F.count(F.lit(1)) + 1).alias("n"), F.lit(700).alias("width"))
    return r6(linkage.step_bounds(merges, shape), "height")


@query(
    "weight_accumulation",
    """WITH s AS (SELECT p_brand AS sample_id, p_size AS step, p_partkey % 20 + 1 AS pos, max(p_retailprice) / 3000 AS score FROM part GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pos ORDER BY step) AS k FROM s),
    w AS (SELECT sample_id, pos, sum(score / (50 * k)) AS w, count(*) AS hit_count FROM k GROUP BY ALL),
    c AS (SELECT sample_id, pos, coalesce(w, 0) AS w, coalesce(hit_count, 0) AS hit_count FROM (SELECT DISTINCT sample_id FROM s) CROSS JOIN (SELECT unnest(range(1, 26)) AS pos) LEFT JOIN w USING (sample_id, pos)),
    f AS (SELECT *, least(sum(w) OVER p / nullif(count(*) FILTER (w = 0) OVER p, 0), 0.1 * max(w) OVER p) AS fl FROM c WINDOW p AS (PARTITION BY sample_id))
    SELECT sample_id, pos, round(1000 * CASE WHEN w > 0 THEN w ELSE fl END, 6) AS weight, hit_count FROM f""",
)
def weight_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of scores made from ``part``: brands are samples, sizes steps; five of 25 columns have no score."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    scores = p.groupBy(F.col("p_brand").alias("sample_id"), F.col("p_size").alias("step"), (F.col("p_partkey") % 20 + 1).alias("pos")).agg((F.max("p_retailprice") / 3000).alias("score"))
    columns_ = scores.select("sample_id").distinct().select("sample_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(25).cast("long"))).alias("pos"))
    return r6(linkage.accumulated(scores, columns_), "weight")
