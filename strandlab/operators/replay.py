"""The adaptive sweep as a filter: every candidate is evaluated in parallel, then the rules say which rows the sweep would have seen.

Scores are scaled over the rows seen, so rows that an early stop or a missing refinement skips are taken out before scoring.
A row's ``step`` is its place in the order of evaluation. Each sample has a few dozen candidates at most, so windows and
groups by sample stay small; samples are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.operators.distances import sweep_score
from strandlab.stages import cut

MEASURES = ["n_clusters", "max_size", "in_cluster", "noise_frac", "prob_mean", "stability_mean", "ambig_bases", "ambig_bases_raw"]


def _given(cfg: Config) -> tuple[list[int], list[int]]:
    """The grid and the extra values, positive, ascending, each once."""
    grid = cfg.grid() if callable(cfg.grid) else cfg.grid
    return sorted({int(g) for g in grid if g > 0}), sorted({int(m) for m in cfg.extra_min_pts if m > 0})


def in_grid(cfg: Config = DEFAULT, value: str = "min_pts", n: str = "n") -> Column:
    """Whether ``value`` is on the grid of a sample of ``n`` reads: below ``n``; the extra values where nothing is left of the grid."""
    grid, extra = _given(cfg)
    v, most = F.col(value), F.col(n) - 1
    fits = F.lit(bool(grid)) & (most >= F.lit(min(grid, default=0)))
    return F.when(fits, v.isin(grid) & (v <= most)).otherwise(v.isin(extra) & v.between(F.lit(3), most))


def candidates(sizes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, n, min_pts): every value that the rules may ask for. ``sizes`` is (sample_id, n)."""
    grid, extra = _given(cfg)
    every = sorted({*grid, *extra, *(m for g in (grid[:1] or [0]) + extra for m in range(max(3, g // 2), g))})
    rows = sizes.select("sample_id", "n", F.explode(F.array(*map(F.lit, every))).alias("min_pts"))
    return rows.where((F.col("min_pts") <= F.col("n") - 1) & (in_grid(cfg) | (F.col("min_pts") >= 3)))


def _best(scored: DataFrame) -> DataFrame:
    """Per sample: the best row, the best with clusters, and what the refinement rules look at. Ties go to the row seen first."""
    row = F.struct((-F.col("objective")).alias("o"), "step", "min_pts", "n_clusters", "ambig_bases", "ambig_bases_raw")
    positive = F.col("n_clusters") > 0
    some = F.when(positive & (F.col("ambig_bases") > 0), F.col("ambig_bases"))
    return scored.groupBy("sample_id").agg(
        F.min(row).alias("best"), F.min(F.when(positive, row)).alias("top"), F.min(F.when(positive, F.col("min_pts"))).alias("edge"), F.min("min_pts").alias("least"),
        F.percentile(some, F.lit(0.5)).alias("mid_ambig"), F.percentile(F.when(positive, F.col("n_clusters")), F.lit(0.5)).alias("mid_clusters"), F.max("step").alias("last"),
    )


def first_pass(rows: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """``rows`` (with n) with step and seen: the middle three of the grid, which end the sweep if they agree on a number of
    clusters and have no ambiguity, then the rest, until half the grid has been seen without a cluster."""
    sample = Window.partitionBy("sample_id")
    out = rows.withColumn("grid", in_grid(cfg)).withColumn("size", F.count_if("grid").over(sample))
    out = out.withColumn("place", F.row_number().over(sample.orderBy(F.col("grid").desc(), "min_pts")) - 1)
    mid = F.floor((F.col("size") + 1) / 2) - 1
    out = out.withColumn("first", F.col("grid") & ((F.col("size") < 3) | F.col("place").between(mid - 1, mid + 1)))
    order = sample.orderBy(F.col("grid").desc(), F.col("first").desc(), "min_pts")
    of_first = lambda f, c: f(F.when(F.col("first"), F.col(c))).over(sample)
    agree = (F.col("size") >= 3) & (of_first(F.min, "n_clusters") == of_first(F.max, "n_clusters")) & (of_first(F.min, "n_clusters") > 0) & (of_first(F.max, "ambig_bases_raw") == 0)
    out = out.withColumn("step", F.row_number().over(order)).withColumn("agree", agree)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    ends = F.col("grid") & ~F.col("first") & (2 * F.col("step") >= F.col("size")) & (F.max("n_clusters").over(upto) == 0)
    out = out.withColumn("ends", ends.cast("int"))
    ended = F.coalesce(F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) > 0
    return out.withColumn("seen", F.col("grid") & (F.col("first") | ~F.col("agree")) & ~ended).drop("size", "place", "first", "agree", "ends")


def replay(evaluated: DataFrame, sizes: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The rows that the adaptive sweep sees, with step, objective and rank (1 is best; least min_pts on ties).

    ``evaluated``: (sample_id, min_pts, measures of ``MEASURES``), a row per candidate; ``sizes``: (sample_id, n). A value that
    the rules ask for and ``evaluated`` lacks counts as not asked for.
    """
    _, extra = _given(cfg)
    early, late = (extra[:-1], extra[-1:]) if len(extra) > 1 else (extra, [])
    rows = cut(first_pass(evaluated.select("sample_id", "min_pts", *MEASURES).join(sizes.select("sample_id", "n"), "sample_id"), cfg))
    scored = lambda df: sweep_score(df, cfg).select(*df.columns, "objective")
    first = rows.where("seen").drop("seen")
    found = _best(scored(first))
    dirty = F.col("top").isNotNull() & ~((F.col("best.n_clusters") > 0) & (F.col("best.ambig_bases_raw") == 0))
    refine = dirty & (F.col("top.min_pts") == F.col("edge")) & F.col("mid_ambig").isNotNull() & (F.col("top.ambig_bases") >= F.col("mid_ambig")) & (F.col("top.n_clusters") <= F.col("mid_clusters"))
    rest = rows.where(~F.col("seen")).drop("seen", "step").join(found.withColumn("refine", refine), "sample_id")
    asked = F.col("refine") & (F.col("min_pts") >= 3) & (F.col("min_pts") < F.col("top.min_pts"))
    below = F.col("top").isNull() & (F.col("min_pts") >= F.greatest(F.lit(3), F.floor(F.col("least") / 2))) & (F.col("min_pts") < F.col("least"))
    wave = F.when(asked & F.col("min_pts").isin(early), 1).when(asked & F.col("min_pts").isin(late), 2).when(below, 1)
    rest = rest.withColumn("wave", wave).where("wave is not null")
    step = F.col("last") + F.row_number().over(Window.partitionBy("sample_id").orderBy("wave", "min_pts"))
    rest = cut(rest.withColumn("step", step.cast("int")))
    # the second wave comes only after a first one that did not lower the ambiguity of the best row with clusters
    some = cut(first.unionByName(rest.where("wave = 1").select(*first.columns)))
    again = _best(scored(some)).select("sample_id", F.col("top.ambig_bases").alias("now"), F.col("last").alias("upto"))
    goes_on = (F.col("upto") > F.col("last")) & (F.col("now") >= F.col("top.ambig_bases"))
    second = rest.where("wave = 2").join(again, "sample_id").where(goes_on)
    out = scored(some.unionByName(second.select(*first.columns)))
    # smaller values mustn't break up large clusters: those that do rank last
    sample = Window.partitionBy("sample_id")
    large = F.max(F.when(F.col("grid") & (F.col("n_clusters") > 0), F.col("max_size"))).over(sample)
    floor_of = F.greatest(*(F.when(large >= f, f) for f in (0.1 * F.col("n"), F.lit(6.0))))
    broken = (F.col("min_pts") < F.min(F.when(F.col("grid"), F.col("min_pts"))).over(sample)) & (F.col("max_size") < floor_of)
    worst = F.min("objective").over(sample) - 1
    out = out.withColumn("objective", F.when(broken, worst).otherwise(F.col("objective")))
    rank = F.row_number().over(sample.orderBy(F.col("objective").desc(), "min_pts"))
    return out.select("sample_id", "min_pts", *MEASURES, "step", "objective", rank.alias("rank"))
