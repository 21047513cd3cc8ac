"""Queries on consensuses, merging, and the set and join operators between stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlab.operators import consensus as c
from strandlab.plans import columns, fixture
from strandlab.plans.catalog import query
from strandlab.plans.reads import r6
from strandlab.stages import cut

READS, RUNS = fixture.sql(8), fixture.sql(8, True)
CODE = "CASE WHEN a + c + g + t = 0 THEN 'N' WHEN mask = 0 THEN CASE greatest(a, c, g, t) WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END ELSE substr('ACMGRSVTWYHKDBN', mask::INT, 1) END"
VOTES = f"""
w0 AS (SELECT *, (q >= 15 AND base IN ('A', 'C', 'G', 'T')) OR base = '-' AS valid FROM bases),
w1 AS (SELECT *, count(*) FILTER (valid) OVER (PARTITION BY sample_id, truth, pos) AS nv, row_number() OVER (PARTITION BY sample_id, truth, pos ORDER BY q DESC, read_ord) AS best FROM w0),
vt AS (SELECT sample_id, truth AS cluster, pos, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base = '-') AS gap
  FROM w1 WHERE CASE WHEN nv >= 3 THEN valid ELSE best <= 3 END GROUP BY ALL),
vm AS (SELECT *, CASE WHEN a >= 3 AND a / (a + c + g + t) >= 0.25 THEN 1 ELSE 0 END + CASE WHEN c >= 3 AND c / (a + c + g + t) >= 0.25 THEN 2 ELSE 0 END + CASE WHEN g >= 3 AND g / (a + c + g + t) >= 0.25 THEN 4 ELSE 0 END + CASE WHEN t >= 3 AND t / (a + c + g + t) >= 0.25 THEN 8 ELSE 0 END AS mask FROM vt),
sz AS (SELECT sample_id, truth AS cluster, count(DISTINCT read_id) AS n_seq FROM bases GROUP BY ALL HAVING n_seq >= 6),
cl AS (SELECT sample_id, cluster, pos, a, c, g, t, gap, CASE WHEN gap > a + c + g + t THEN '-' ELSE {CODE} END AS code FROM vm SEMI JOIN sz USING (sample_id, cluster))"""
# the homopolymer mask within clusters, on which the derived reads' consensus differs in masked columns
HPC = columns.HP.replace("sample_id, read_id", "sample_id, truth, read_id").replace("sample_id, pos", "sample_id, truth, pos").replace(">= 5 AND", ">= 6 AND")
MASKC = columns.MASK.replace("0.33", "0.5").replace("0.0625", "0.2").replace("sample_id", "sample_id, truth")
CONS = f"""{VOTES}, {HPC}, {MASKC},
cm AS (SELECT cl.*, CASE WHEN coalesce(masked, false) THEN CASE WHEN greatest(gap, a, c, g, t) = 0 THEN 'N' ELSE CASE greatest(gap, a, c, g, t) WHEN gap THEN '-' WHEN a THEN 'A' WHEN c THEN 'C' WHEN g THEN 'G' ELSE 'T' END END ELSE code END AS k
  FROM cl LEFT JOIN mask m ON m.sample_id = cl.sample_id AND m.truth = cl.cluster AND m.pos = cl.pos),
cons AS (SELECT sample_id, cluster, string_agg(k, '' ORDER BY pos) AS seq, n_seq FROM cm JOIN sz USING (sample_id, cluster) GROUP BY ALL)"""
MASKS = "{'A': 1, 'C': 2, 'M': 3, 'G': 4, 'R': 5, 'S': 6, 'V': 7, 'T': 8, 'W': 9, 'Y': 10, 'H': 11, 'K': 12, 'D': 13, 'B': 14, 'N': 15}"
DIFF = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda p: CASE WHEN substr({x}, p, 1) = '-' AND substr({y}, p, 1) = '-' THEN 0 WHEN substr({x}, p, 1) = '-' OR substr({y}, p, 1) = '-' THEN 1 WHEN (instr('ACMGRSVTWYHKDBN', substr({x}, p, 1)) & instr('ACMGRSVTWYHKDBN', substr({y}, p, 1))) > 0 THEN 0 ELSE 1 END))"
STRICT = lambda x, y: f"list_sum(list_transform(range(1, len({x}) + 1), lambda p: CASE WHEN substr({x}, p, 1) = substr({y}, p, 1) THEN 0 ELSE 1 END))"
DIV = f"""{CONS},
rk AS (SELECT sample_id, truth AS cluster, read_ord, aln_seq FROM reads QUALIFY row_number() OVER (PARTITION BY sample_id, truth ORDER BY md5(read_id), read_id) <= 200),
imd AS (SELECT a.sample_id, a.cluster, quantile_cont(100.0 * {STRICT("a.aln_seq", "b.aln_seq")} / len(a.aln_seq), 0.5) AS imd FROM rk a JOIN rk b ON a.sample_id = b.sample_id AND a.cluster = b.cluster AND a.read_ord < b.read_ord GROUP BY ALL),
tc AS (SELECT cons.sample_id, cons.cluster, 100.0 * {DIFF("aln_seq", "seq")} / len(seq) AS d FROM reads JOIN cons ON cons.sample_id = reads.sample_id AND cons.cluster = truth),
nr AS (SELECT sample_id, cluster, avg(d) AS iad, quantile_cont(d, 0.5) AS mdc FROM tc GROUP BY ALL),
st AS (SELECT sample_id, cluster, seq, n_seq, imd, iad, mdc, len(regexp_replace(seq, '[^RYKMSWBDHVN]', '', 'g'))::INT AS n_iupac, len(replace(seq, '-', ''))::INT AS len FROM cons LEFT JOIN imd USING (sample_id, cluster) LEFT JOIN nr USING (sample_id, cluster))"""
HEADER = "concat('CL', cluster, '_IMD', printf('%.2f', imd), '_MDC', printf('%.2f', mdc), '_NIUPAC', n_iupac, '_NSEQ', n_seq, '_LEN', len)"


def reads_of(spark: SparkSession, sf_dir: str, runs: bool = False) -> DataFrame:
    return fixture.aligned(spark, sf_dir, runs=runs).withColumnRenamed("truth", "cluster")


def called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(c.consensus(reads_of(spark, sf_dir, True)))


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.divergence(reads_of(spark, sf_dir, True), called(spark, sf_dir))


@query("iupac", f"WITH {READS}, {VOTES} SELECT sample_id, cluster, pos, code FROM cl")
def iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.votes(c.read_ballots(reads_of(spark, sf_dir))).select("sample_id", "cluster", "pos", c.column_call().alias("code"))


@query("consensus", f"WITH {RUNS}, {CONS} SELECT sample_id, cluster, seq, n_seq FROM cons")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.consensus(reads_of(spark, sf_dir, True)).select("sample_id", "cluster", "seq", "n_seq")


@query("divergence", f"WITH {RUNS}, {DIV} SELECT sample_id, cluster, n_seq, round(imd, 6) AS imd, round(iad, 6) AS iad, round(mdc, 6) AS mdc, n_iupac, len FROM st")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r6(stats(spark, sf_dir).drop("seq"), "imd", "iad", "mdc")


@query("header_parse", f"WITH {RUNS}, {DIV} SELECT sample_id, cluster, round(imd, 2) AS imd, round(mdc, 2) AS mdc, n_iupac, n_seq::INT AS n_seq, len FROM st")
def header_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records out to headers and back."""
    return r6(c.parse_headers(c.label(stats(spark, sf_dir)).select("sample_id", "header")), "imd", "mdc", digits=2)


@query("final_results", f"WITH {RUNS}, {DIV} SELECT concat(sample_id, '__', {HEADER}) AS name, replace(seq, '-', '') AS seq FROM st")
def final_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.final_results(c.label(stats(spark, sf_dir)))


MERGE_MASK = """
hpm AS (SELECT sample_id, unnest(range(p, p + len(r))) AS pos FROM (
  SELECT sample_id, p, regexp_extract(substr(seq, p), '^(A[AMRVWHDN-]*|C[CMSVYHBN-]*|G[GRSVKDBN-]*|T[TWYHKDBN-]*)', 1) AS r FROM (SELECT sample_id, seq, unnest(range(1, len(seq) + 1)) AS p FROM cons)) WHERE len(replace(r, '-', '')) >= 6),
dgm AS (SELECT sample_id, seq, list_filter(range(1, len(seq) + 1), lambda p: substr(seq, p, 1) <> '-') AS ps, replace(seq, '-', '') AS d FROM cons),
rep AS (SELECT sample_id, ps[i] AS f, ps[i + u * 4 - 1] AS l FROM (SELECT sample_id, ps, d, u, unnest(range(1, greatest(len(d) - u * 4 + 2, 1))) AS i FROM dgm, (VALUES (2), (3)) v(u)) WHERE substr(d, i, u * 4) = repeat(substr(d, i, u), 4) AND regexp_matches(substr(d, i, u * 4), '^[ACGT]+$')),
mm AS (SELECT DISTINCT sample_id, pos::INT AS pos FROM (SELECT sample_id, pos FROM hpm UNION ALL SELECT sample_id, unnest(range(f, l + 1)) FROM rep))"""


@query("merge_mask", f"WITH {RUNS}, {CONS}, {MERGE_MASK} SELECT sample_id, pos FROM mm")
def merge_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.merge_mask(called(spark, sf_dir))


@query(
    "single_linkage",
    f"""WITH RECURSIVE {RUNS}, {CONS}, {MERGE_MASK},
    kp AS (SELECT sample_id, cluster, array_to_string(list_transform(list_filter(range(1, len(seq) + 1), lambda p: NOT list_contains(coalesce(drops, []), p)), lambda p: substr(seq, p, 1)), '') AS kept
      FROM cons LEFT JOIN (SELECT sample_id, list(pos) AS drops FROM mm GROUP BY ALL) USING (sample_id)),
    ds AS (SELECT a.sample_id, a.cluster AS i, b.cluster AS j FROM kp a JOIN kp b ON a.sample_id = b.sample_id AND a.cluster < b.cluster WHERE a.kept <> '' AND {DIFF("a.kept", "b.kept")} <= 2),
    reach AS (SELECT sample_id, cluster, cluster AS g FROM cons UNION SELECT reach.sample_id, CASE WHEN i = reach.cluster THEN j ELSE i END, g FROM reach JOIN ds ON ds.sample_id = reach.sample_id AND (i = reach.cluster OR j = reach.cluster))
    SELECT sample_id, cluster, min(g) AS "group" FROM reach GROUP BY ALL""",
)
def single_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At height 2: the planted clusters that differ in two columns join."""
    cons = called(spark, sf_dir)
    kept = c.trimmed(cons, c.merge_mask(cons)).cache()
    return c.single_linkage(kept, c.merge_distances(kept), 2)


@query("merge_distance", f"""WITH {RUNS}, {CONS}, {MERGE_MASK},
    kp AS (SELECT sample_id, cluster, array_to_string(list_transform(list_filter(range(1, len(seq) + 1), lambda p: NOT list_contains(coalesce(drops, []), p)), lambda p: substr(seq, p, 1)), '') AS kept
      FROM cons LEFT JOIN (SELECT sample_id, list(pos) AS drops FROM mm GROUP BY ALL) USING (sample_id))
    SELECT a.sample_id, a.cluster AS ord_i, b.cluster AS ord_j, {DIFF("a.kept", "b.kept")}::INT AS d FROM kp a JOIN kp b ON a.sample_id = b.sample_id AND a.cluster < b.cluster WHERE a.kept <> '' AND b.kept <> ''""")  # fmt: skip
def merge_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    cons = called(spark, sf_dir)
    return c.merge_distances(c.trimmed(cons, c.merge_mask(cons)))


@query("cluster_sizes", "WITH r AS (SELECT (o_custkey % 8)::VARCHAR AS sample_id, o_orderstatus AS cluster FROM orders) SELECT sample_id, cluster, n, round(n / sum(n) OVER (PARTITION BY sample_id), 6) AS share FROM (SELECT sample_id, cluster, count(*) AS n FROM r GROUP BY ALL)")
def cluster_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = reads_of(spark, sf_dir).groupBy("sample_id", "cluster").agg(F.count(F.lit(1)).alias("n"))
    return r6(n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("sample_id"))), "share")


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer"))


@query("lookup_join", "SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cust = tables(spark, sf_dir)
    return o.join(cust, o.o_custkey == cust.c_custkey, "left").select("o_orderkey", "c_name", "c_mktsegment")


@query("semi", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cust = tables(spark, sf_dir)
    return cust.join(o.where("o_orderstatus = 'P'"), cust.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


@query("anti", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, cust = tables(spark, sf_dir)
    return cust.join(o.where("o_orderstatus = 'P'"), cust.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


SETS = ("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'")


def two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return tuple(o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("k")) for s in "FP")


@query("set_union", " UNION ".join(SETS))
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.union(b).distinct()


@query("set_intersect", " INTERSECT ".join(SETS))
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.intersect(b)


@query("set_except", " EXCEPT ".join(SETS))
def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = two_sets(spark, sf_dir)
    return a.exceptAll(b.distinct()).join(b.distinct(), "k", "left_anti").distinct()


@query("union_all", f"SELECT k, 'F' AS s, NULL::VARCHAR AS t FROM ({SETS[0]}) UNION ALL SELECT k, NULL, 'P' FROM ({SETS[1]})")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables with differing columns under each other; what one lacks is null."""
    a, b = two_sets(spark, sf_dir)
    return a.withColumn("s", F.lit("F")).unionByName(b.withColumn("t", F.lit("P")), allowMissingColumns=True)


@query("sample_n", "SELECT o_custkey::VARCHAR AS sample_id, o_orderkey AS read_ord FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY md5(o_orderkey::VARCHAR), o_orderkey) <= 5")
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five reads per sample without replacement, in hash order: the sampling operator."""
    reads = fixture.aligned(spark, sf_dir, None)
    order = Window.partitionBy("sample_id").orderBy(F.md5("read_id"), "read_ord")
    return reads.withColumn("r", F.row_number().over(order)).where("r <= 5").select("sample_id", "read_ord")


@query("top_k", "SELECT o_custkey AS sample_id, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    best = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return o.withColumn("r", F.row_number().over(best)).where("r <= 3").select(F.col("o_custkey").alias("sample_id"), "o_orderkey", "o_totalprice")


@query("gap_filter", "WITH e AS (SELECT user_id, event_id, value, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM events) SELECT user_id, event_id, round(value, 6) AS value FROM e WHERE step > 1 OR step IS NULL")
def gap_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values kept where they exceed the one before by a least step, the first of a group always (W7)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return r6(e.withColumn("step", step).where("step > 1 or step is null").select("user_id", "event_id", "value"), "value")
