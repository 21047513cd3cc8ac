"""Links and components for similarity joins over buckets, without all pairs of a group.

``connect`` finds every component of the graph of links between the members of shared buckets. Rounds of stars come
first: in each bucket every member is compared with one leader, unless both are in one component already, so a group
of m copies costs about m comparisons. What is left are pairs of different components; ``connect`` then compares all
of those that may link, so no link between components is lost. Labels live in tables; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import drop_staged, free_shuffles, fresh_key, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for the ends of ``edges`` (a, b): label is the least id of the component.

    Least neighbour labels and label-of-label jumps, until nothing changes; hubs meet through keys that adaptive
    execution can split.
    """
    both = stage(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("b")).select("id", F.least("id", "b").alias("label")), "labels")
    while True:
        ends = labels.select(fresh_key(F.col("id")).alias("key"), "label")
        around = both.select("a", fresh_key(F.col("b")).alias("key")).join(ends, "key").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        mid = labels.join(around, "id").select("id", "label", F.least("label", "near").alias("least"))
        jump = mid.select(F.col("least").alias("least"), "id", "label", fresh_key(F.col("least")).alias("key")).join(labels.select(fresh_key(F.col("id")).alias("key"), F.col("label").alias("up")), "key", "left")
        new = stage(jump.select("id", F.least("least", F.coalesce("up", "least")).alias("label"), (F.least("least", F.coalesce("up", "least")) != F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_staged(labels)
        labels = new.drop("moved")
        if not moved:
            drop_staged(both)
            return labels


def relabel(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after ``links`` (a, b) have joined components; ids without a label are their own."""
    if labels is None:
        return components(links)
    at = lambda c: labels.select(fresh_key(F.col("id")).alias(f"k{c}"), F.col("label").alias(f"l{c}"))
    up = links.withColumn("ka", fresh_key(F.col("a"))).withColumn("kb", fresh_key(F.col("b"))).join(at("a"), "ka", "left").join(at("b"), "kb", "left")
    up = up.select("a", "b", F.coalesce("la", "a").alias("la"), F.coalesce("lb", "b").alias("lb"))
    tops = components(up.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    known = labels.union(links.select("a", "a")).union(links.select("b", "b")).groupBy("id").agg(F.min("label").alias("label"))
    tops = tops.select(fresh_key(F.col("id")).alias("key"), F.col("label").alias("top"))
    return stage(known.withColumn("key", fresh_key(F.col("label"))).join(tops, "key", "left").select("id", F.coalesce("top", "label").alias("label")), "labels")


def stars(
    members: DataFrame,
    features: list[str],
    promising: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    labels: DataFrame | None = None,
    turns: int = 2,
    leaders: int = 4,
) -> DataFrame | None:
    """Labels after up to ``turns`` rounds of comparisons between the members of a bucket (key, id, *features) and a leader, the pairs of one label left out.

    Leaders are drawn anew each turn, and in ``leaders`` ways by key, so that a group with many keys has several: lines that
    aren't near one leader are near another. Of ``features``, spare is what a pair must share beyond one key. A turn makes a pair per member row at most, whatever the sizes of the buckets. What
    ``verify`` returns is read several times, so it should be a staged table; it is deleted at the end.
    """
    fresh = lambda df, name: df.select(fresh_key(F.col("key")).alias("key"), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "key"))
    for turn in range(turns):
        df = members.withColumn("label", F.col("id"))
        if labels is not None:
            up = labels.select(fresh_key(F.col("id")).alias("kid"), F.col("label").alias("up"))
            df = members.withColumn("kid", fresh_key(F.col("id"))).join(up, "kid", "left").select("key", "id", *features, F.coalesce("up", "id").alias("label"))
        drawn = F.xxhash64("id", F.lit(turn), F.pmod("key", F.lit(leaders)))
        heads = df.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("id", "label", *features), drawn).alias("head"))
        heads = heads.where("low != high").select("key", "head.*")
        pairs = fresh(heads, "x").join(fresh(df, "y"), "key").where((F.col("x_label") != F.col("y_label")) & promising("x_", "y_"))
        pairs = pairs.groupBy(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).agg(F.count(F.lit(1)).alias("shared"), F.max(F.least("x_spare", "y_spare")).alias("spare"))
        pairs = stage(pairs.where("shared > spare").select("a", "b"), "star-pairs")
        if not pairs.limit(1).count():
            return labels
        links = verify(pairs)
        drop_staged(pairs)
        if links.limit(1).count():
            labels = relabel(labels, links)
        drop_staged(links)
    return labels


def link_pairs(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame], labels: DataFrame | None = None, turns: int = 2) -> DataFrame | None:
    """Labels after all links among ``pairs`` (a, b, shared), a staged table that is deleted.

    In each of ``turns`` only the pair with the most shared keys of each line is verified; pairs of one label then need
    no test, so of a group of lines like each other few pairs are left. At last the rest is verified. ``verify`` gives staged tables.
    """
    for turn in range(turns + 1):
        if not pairs.limit(1).count():
            break
        best = pairs.select("a", "b")
        if turn < turns:
            top = lambda x, y: pairs.groupBy(x).agg(F.max_by(y, F.struct("shared", y)).alias(y)).select("a", "b")
            best = stage(top("a", "b").union(top("b", "a")).distinct(), "best-pairs")
        links = verify(best)
        if links.limit(1).count():
            labels = relabel(labels, links)
        if turn == turns:
            break
        rest = pairs.join(best, ["a", "b"], "left_anti")
        if labels is not None:
            at = lambda c: labels.select(fresh_key(F.col("id")).alias(f"k{c}"), F.col("label").alias(f"l{c}"))
            rest = rest.withColumn("ka", fresh_key(F.col("a"))).withColumn("kb", fresh_key(F.col("b"))).join(at("a"), "ka", "left").join(at("b"), "kb", "left")
            rest = rest.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b", "shared")
        rest = stage(rest, "pairs")
        drop_staged(pairs, best, links)
        pairs = rest
        free_shuffles(pairs.sparkSession)
    drop_staged(pairs)
    return labels


def connect(
    members: DataFrame,
    features: list[str],
    promising: Callable[[str, str], Column],
    may_link: Callable[[DataFrame], DataFrame],
    verify: Callable[[DataFrame], DataFrame],
    rounds: int = 1,
    labels: DataFrame | None = None,
) -> tuple[DataFrame | None, list[DataFrame]]:
    """(labels or None, links found) over ``members`` (key, id, *features), starting from ``labels``.

    ``promising(x, y)``: may the pair with features under prefixes x and y link, judged by one bucket alone?
    ``may_link``: of all rows (a, b, features by prefix) of pairs, one row (a, b, shared) per pair that may link.
    ``verify``: of pairs (a, b), those that link.
    """
    links: list[DataFrame] = []
    checked: DataFrame | None = None
    fresh = lambda df, name: df.select(fresh_key(F.col("key")).alias("key"), *(F.col(c).alias(f"{name}_{c}") for c in df.columns if c != "key"))

    def labelled() -> DataFrame:
        if labels is None:
            return members.withColumn("label", F.col("id"))
        up = labels.select(fresh_key(F.col("id")).alias("kid"), F.col("label").alias("up"))
        return members.withColumn("kid", fresh_key(F.col("id"))).join(up, "kid", "left").select("key", "id", *features, F.coalesce("up", "id").alias("label"))

    def leaders(df: DataFrame, turn: int) -> DataFrame:
        first = F.col("id") if not turn else F.xxhash64("id", F.lit(turn))
        several = df.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min_by(F.struct("id", "label", *features), first).alias("head"))
        return several.where("low != high").select("key", "head.*")

    def test(pairs: DataFrame) -> None:
        nonlocal labels, checked
        pairs = stage(pairs, "pairs")
        if not pairs.limit(1).count():
            return
        found = stage(verify(pairs), "links")
        checked = pairs if checked is None else checked.union(pairs)
        if found.limit(1).count():
            links.append(found)
            labels = relabel(labels, found)

    for turn in range(rounds + 1):
        last = turn == rounds
        df = stage(labelled(), "members") if labels is not None else labelled()
        heads = stage(leaders(df, turn), "leaders")
        # the last turn compares everything outside its leader's component with all members of the bucket, two outsiders once
        of = df.join(heads.select("key", F.col("label").alias("of")), "key").withColumn("out", F.col("label") != F.col("of")).drop("of") if last else None
        x = fresh(of.where("out") if last else heads, "x")
        pairs = x.join(fresh(of if last else df, "y"), "key").where((F.col("x_label") != F.col("y_label")) & promising("x_", "y_"))
        pairs = pairs.where(~F.col("y_out") | (F.col("x_id") < F.col("y_id"))) if last else pairs
        swap = F.col("x_id") > F.col("y_id")
        side = lambda p, q: [F.when(swap, F.col(f"{q}_{c}")).otherwise(F.col(f"{p}_{c}")).alias(f"{n}_{c}") for c in features for n in ({"x": "a", "y": "b"}[p],)]
        pairs = pairs.select("key", F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b"), *side("x", "y"), *side("y", "x"))
        pairs = may_link(pairs)
        if checked is not None:
            pairs = pairs.join(checked, ["a", "b"], "left_anti")
        if not last:
            pairs = pairs.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a"))
        plain = labels is None
        test(pairs.select("a", "b"))
        drop_staged(heads, *([] if plain else [df]))
    return labels, links
