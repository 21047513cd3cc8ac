"""Column weights along an average-linkage tree, as tables.

Average linkage is reducible: two clusters that are each other's nearest stay so whatever else merges. So each round merges all
such pairs of all samples at once. Sums of distances between clusters are additive, which makes an update one sum over the pairs
of clusters that are left. A cluster goes by its least member; the greater of two that merge is absorbed by the lesser, so a
merge is a pointer with a height, and a cut follows the pointers up to its height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.config import DEFAULT, Config
from strandlab.operators import distances, variants
from strandlab.stages import cut

STEPS, SKEW, EXTRA, MANY = 50, 5, 0.10, 50
#: Means in another order of summing differ beyond these digits, and would split ties.
DIGITS = 12


def tree_columns(stats: DataFrame, features: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, pos): the columns the tree is made of. Variants' columns alone from ``MANY`` on, else a tenth of the kept
    columns besides, in hash order; all kept columns where no variant is."""
    kept = kept_columns(stats, cfg)
    marked = kept.join(features.select("sample_id", "pos", F.lit(1).alias("f")).distinct(), ["sample_id", "pos"], "left")
    sample = Window.partitionBy("sample_id")
    marked = marked.withColumns({"n": F.count("f").over(sample), "kept": F.count(F.lit(1)).over(sample)})
    place = F.row_number().over(sample.orderBy(F.col("f").isNotNull(), F.md5(F.col("pos").cast("string")), "pos"))
    other = F.col("f").isNull() & (F.col("n") < MANY) & ((F.col("n") == 0) | (place <= F.ceil(EXTRA * F.col("kept"))))
    return marked.withColumn("use", F.col("f").isNotNull() | other).where("use").select("sample_id", "pos")


def kept_columns(stats: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, pos) of columns whose gaps are few among bases and gaps."""
    return stats.where(F.col("n_gap") <= cfg.max_gap_frac * (F.col("n_gap") + F.col("depth"))).select("sample_id", "pos")


def column_distances(bases: DataFrame, columns: DataFrame) -> DataFrame:
    """(sample_id, ord_i, ord_j, d): columns, of the given ones, in which two reads differ."""
    rows = bases.join(columns, ["sample_id", "pos"]).groupBy("sample_id", "read_ord").agg(F.sort_array(F.collect_list(F.struct("pos", "base"))).alias("x"))
    rows = rows.select("sample_id", "read_ord", F.array_join(F.transform("x", lambda c: c["base"]), "").alias("s"))
    pairs = distances.pairs(rows, "read_ord", "s")
    differ = F.aggregate(F.zip_with(F.split("s_i", ""), F.split("s_j", ""), lambda a, b: (a != b).cast("int")), F.lit(0), lambda n, x: n + x)
    return pairs.select(*distances.PAIR, differ.cast("double").alias("d"))


def average_linkage(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sample_id, into, ord, height, size): merges of average linkage; ``into`` is the merged cluster's least member, ``ord`` the
    other's. ``nodes``: (sample_id, ord); ``pairs``: every pair (sample_id, ord_i, ord_j, d).

    Equal distances go by the clusters' least members within a round.
    """
    sizes = nodes.select("sample_id", "ord", F.lit(1).cast("long").alias("m"))
    state = pairs.select("sample_id", F.least("ord_i", "ord_j").alias("a"), F.greatest("ord_i", "ord_j").alias("b"), F.col("d").alias("s"))
    found: list[DataFrame] = []
    while True:
        side = lambda c, m: sizes.select("sample_id", F.col("ord").alias(c), F.col("m").alias(m))
        means = state.join(side("a", "ma"), ["sample_id", "a"]).join(side("b", "mb"), ["sample_id", "b"])
        means = cut(means.select("sample_id", "a", "b", "s", F.struct(F.round(F.col("s") / (F.col("ma") * F.col("mb")), DIGITS).alias("d"), "a", "b").alias("e"), (F.col("ma") + F.col("mb")).alias("m")))
        if means.isEmpty():
            break
        ends = means.select("sample_id", F.explode(F.array("a", "b")).alias("x"), "e", "m")
        near = ends.groupBy("sample_id", "x").agg(F.min(F.struct("e", "m")).alias("best"))
        both = near.groupBy("sample_id", "best").agg(F.count(F.lit(1)).alias("n")).where("n = 2")
        merges = cut(both.select("sample_id", F.col("best.e.a").alias("into"), F.col("best.e.b").alias("ord"), F.col("best.e.d").alias("height"), F.col("best.m").alias("size")))
        found.append(merges)
        moved = lambda c, to: merges.select("sample_id", F.col("ord").alias(c), F.col("into").alias(to))
        left = means.join(moved("a", "ra"), ["sample_id", "a"], "left").join(moved("b", "rb"), ["sample_id", "b"], "left")
        left = left.select("sample_id", F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"), "s").where("x != y")
        state = cut(left.groupBy("sample_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("s").alias("s")))
        grown = merges.select("sample_id", F.col("into").alias("ord"), "size")
        sizes = cut(sizes.join(merges.select("sample_id", "ord"), ["sample_id", "ord"], "left_anti").join(grown, ["sample_id", "ord"], "left").select("sample_id", "ord", F.coalesce("size", "m").alias("m")))
    if not found:
        return nodes.sparkSession.createDataFrame([], "sample_id string, into long, ord long, height double, size long")
    out = found[0]
    for more in found[1:]:
        out = out.unionAll(more)
    return out


def step_bounds(merges: DataFrame, shape: DataFrame, min_step: float = 0.01, min_share: float = 0.1) -> DataFrame:
    """(sample_id, step, height): heights at which the tree is cut, steps from 1.

    Quantiles of the heights of the later merges, whose rank by height reaches a tenth of the reads and a hundredth of the width,
    at skewed probabilities; each more than ``min_step`` of the greatest height above the one before. Without two of those, the
    greatest height alone. ``shape``: (sample_id, n, width). The first quantile isn't cut at.
    """
    up = Window.partitionBy("sample_id").orderBy("height", "into", "ord")
    ranked = merges.join(shape, "sample_id").withColumn("rank", F.row_number().over(up))
    late = F.col("rank") >= F.greatest(F.bround(F.col("width") / 100), min_share * F.col("n"))
    probs = F.array(*(F.lit((k / STEPS) ** SKEW) for k in range(STEPS + 1)))
    one = ranked.groupBy("sample_id").agg(F.max("height").alias("top"), F.count_if(late).alias("n_late"), F.percentile(F.when(late, F.col("height")), probs).alias("q"))
    rows = one.select("sample_id", "top", "n_late", F.posexplode_outer("q").alias("k", "height"))
    before = F.lag("height").over(Window.partitionBy("sample_id").orderBy("k"))
    apart = F.col("height") - before > min_step * F.col("top")
    kept = rows.withColumn("apart", apart).where((F.col("n_late") >= 2) & F.col("apart"))
    plain = one.join(kept.select("sample_id").distinct(), "sample_id", "left_anti").select("sample_id", F.lit(1).alias("k"), F.col("top").alias("height"))
    step = F.row_number().over(Window.partitionBy("sample_id").orderBy("k"))
    return kept.select("sample_id", "k", "height").unionAll(plain).select("sample_id", step.alias("step"), "height")


def cut_tree(nodes: DataFrame, merges: DataFrame, bounds: DataFrame) -> DataFrame:
    """(sample_id, step, ord, cluster): the groups after all merges up to each step's height; ``cluster`` is the least member.

    Pointers are replaced by their pointers' pointers, a logarithmic number of times.
    """
    at = bounds.join(nodes.select("sample_id", "ord"), "sample_id").join(merges.select("sample_id", "ord", "into", F.col("height").alias("h")), ["sample_id", "ord"], "left")
    at = cut(at.select("sample_id", "step", "ord", F.when(F.col("h") <= F.col("height"), F.col("into")).otherwise(F.col("ord")).alias("cluster")))
    while True:
        up = at.select("sample_id", "step", F.col("ord").alias("cluster"), F.col("cluster").alias("far"))
        new = cut(at.join(up, ["sample_id", "step", "cluster"]).select("sample_id", "step", "ord", F.col("far").alias("cluster"), (F.col("far") != F.col("cluster")).alias("moved")))
        at = new.drop("moved")
        if new.where("moved").isEmpty():
            return at


def accumulated(scores: DataFrame, columns: DataFrame, steps: int = STEPS) -> DataFrame:
    """(sample_id, pos, weight, hit_count) of all ``columns`` (sample_id, pos): a column's scores (sample_id, step, pos, score), the
    k-th divided by k, over the number of steps; then a floor for columns without any, and times 1000. All 1 where none has any."""
    rn = F.row_number().over(Window.partitionBy("sample_id", "pos").orderBy("step"))
    sums = scores.withColumn("k", rn).groupBy("sample_id", "pos").agg(F.sum(F.col("score") / (steps * F.col("k"))).alias("w"), F.count(F.lit(1)).alias("hit_count"))
    sample = Window.partitionBy("sample_id")
    out = columns.select("sample_id", "pos").join(sums, ["sample_id", "pos"], "left").fillna({"w": 0.0, "hit_count": 0})
    zero = F.count_if(F.col("w") == 0).over(sample)
    floor_ = F.least(F.sum("w").over(sample) / F.nullif(zero, F.lit(0)), 0.1 * F.max("w").over(sample))
    out = out.withColumns({"floor": floor_, "most": F.max("w").over(sample)})
    weight = F.when(F.col("most") == 0, 1.0).otherwise(1000 * F.when(F.col("w") > 0, F.col("w")).otherwise(F.col("floor")))
    return out.select("sample_id", "pos", weight.alias("weight"), "hit_count")


def column_weights(bases: DataFrame, features: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """(sample_id, pos, weight, hit_count): how strongly groups along the tree differ from the rest in a column.

    ``bases``: long (sample_id, read_ord, pos, base); ``features``: (sample_id, pos) of variants.
    """
    counts = variants.column_counts(bases)
    stats = cut(variants.column_stats(counts))
    nodes = cut(bases.select("sample_id", F.col("read_ord").alias("ord")).distinct())
    merges = cut(average_linkage(nodes, column_distances(bases, tree_columns(stats, features, cfg))))
    shape = nodes.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).join(stats.groupBy("sample_id").agg(F.count(F.lit(1)).alias("width")), "sample_id")
    groups = cut_tree(nodes, merges, step_bounds(merges, shape))
    key = F.struct("sample_id", "step")
    large = groups.groupBy("sample_id", "step", "cluster").agg(F.count(F.lit(1)).alias("m")).select(key.alias("sample_id"), "cluster", "m")
    cells = bases.join(groups.withColumnRenamed("ord", "read_ord"), ["sample_id", "read_ord"]).select(key.alias("sample_id"), "cluster", "pos", "base")
    scores = variants.contrast(variants.column_counts(cells, "cluster"), large, min_node=cfg.min_depth).select("sample_id.sample_id", "sample_id.step", "pos", "score")
    return accumulated(scores.join(kept_columns(stats, cfg), ["sample_id", "pos"], "left_semi"), stats)
