"""Operator 10: mix sources to target weights.

Token streams are packed into fixed-length blocks per source; per output shard, source counts come from a seeded
draw; each source's slots map through its own pseudorandom index permutation (a Feistel network with
cycle walking); slots then meet blocks in a join on (source, block index).

The draw goes by source: a source's number of slots is fixed by its target, and its slots fall multinomially into shards
with equal odds. A draw over the sources per shard would miss the targets, or need the counts of all earlier shards; the price is that
shards are of about, not exactly, the same size.

Position in a source's stream needs a running sum. It is taken in two levels, so that a source with a third of all
rows doesn't land in one task: documents are dealt into hash buckets of bounded size, bucket totals are summed per
source, and documents are summed within their bucket.

Null text: size 0. Null source: a source of its own, last. Repeated rows (same doc_id): packed one after the other;
their figures are summed per doc_id and source. Empty table: empty result. Documents without words take 0.
Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import count_words, let, stage, tasks_for, words_of

BLOCK, WEIGHTS, MAX_REPEAT, DOCS_PER_BUCKET, SHARD_WORDS, SEED = 64, (1, 2, 3), 3.0, 2_000, 1 << 22, 17


def null_safe(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit("\x00null"))


def targets(sources: DataFrame, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Per source (source, source_size, rank): its target words, weights 1, 2, 3 repeating in code point order.

    A source is full when its fair share reaches ``max_repeat`` times its size. Ordered by size per weight, full
    sources are a prefix, so one pass of running sums finds the water level: no loop over rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(by_name) - 1) % len(WEIGHTS) + 1).cast("int")).cast("double"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(max_repeat)
    total = F.sum("source_size").over(every).cast("double")
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / open_weight
    out = weighted.withColumn("cap", cap).withColumn("level", level).withColumn("place", F.row_number().over(order))
    first_open = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("place", "level"))).over(every)["level"]
    return out.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(first_open, F.lit(0.0)))).drop("cap", "level", "place")


def packed(sizes: DataFrame, per_bucket: int = DOCS_PER_BUCKET) -> DataFrame:
    """(doc_id, source, size) with ``start``: the document's first word in its source's stream."""
    n = max(1, math.ceil(sizes.count() / per_bucket))
    sizes = sizes.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    sums = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "bucket").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = sums.withColumnRenamed("source", "s2").withColumnRenamed("bucket", "b2")
    joined = sizes.join(sums, sizes.source.eqNullSafe(sums.s2) & (sizes.bucket == sums.b2))
    return joined.select("doc_id", "source", "size", (F.col("base") + F.col("inner")).alias("start"))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 per (n, key): four Feistel rounds on the covering even number of bits."""
    n = np.asarray(n, np.uint64)
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2).astype(float)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = np.asarray(key, np.uint64)

    def once(x: np.ndarray, half: np.ndarray, mask: np.ndarray, key: np.ndarray) -> np.ndarray:
        left, right = x >> half, x & mask
        for r in range(4):
            f = (right + key + np.uint64(r * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((f ^ (f >> np.uint64(32))) & mask)
        return (left << half) | right

    out = once(np.asarray(index, np.uint64), half, mask, key)
    while (out >= n).any():
        again = out >= n
        out[again] = once(out[again], half[again], mask[again], key[again])
    return out.astype(np.int64)


def draw_slots(plan: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (source, shard, slot, block_id, words): the blocks that each output shard takes, the last one cut to fit.

    ``plan`` has a row per source: source, source_size, target and ``total`` over all sources. A source's slots fall
    into shards by a multinomial draw with equal odds, made as a chain of binomials that split the shard range in
    halves, so that the task of any leaf range can repeat its own draws from the seed alone.
    """
    plan = plan.where("target >= 0.5 and source_size > 0")
    slots = F.ceil(F.round("target") / block).cast("long") + 4
    step = 4096
    plan = plan.select("*", F.xxhash64(null_safe("source"), F.lit(seed)).alias("key"), F.explode(F.sequence(F.lit(0).cast("long"), slots, F.lit(step).cast("long"))).alias("first"))
    # by number, since adaptive execution would take rows so narrow for little work and run them in one task
    plan = plan.repartition(tasks_for(plan.sparkSession, plan.count()))

    def fill(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                out = _slots_of(row, block, step, shard_words, seed)
                if len(out):
                    yield out

    schema = "source string, source_key long, shard long, slot long, block_id long, words long"
    return plan.mapInPandas(fill, schema)


def _slots_of(row, block: int, step: int, shard_words: int, seed: int) -> pd.DataFrame:
    size, target, key = int(row.source_size), int(np.floor(row.target + 0.5)), np.uint64(row.key % (1 << 64))
    n, rem = -(-size // block), size - (-(-size // block) - 1) * block
    full, part = divmod(target, size)
    tail = int(_position(n - 1, n, key + np.uint64(full)))
    m = -(-part // block)
    if part > (m * block - (block - rem if tail < m else 0)):
        m += 1
    total = full * n + m
    j = np.arange(row.first, min(row.first + step, total), dtype=np.int64)
    if not len(j):
        return pd.DataFrame()
    epoch = j // n
    ids = permute(j % n, np.full(len(j), n), key + epoch.astype(np.uint64))
    words = np.where(ids == n - 1, rem, block)
    if part and total - 1 == j[-1]:
        before = (m - 1) * block - (block - rem if tail < m - 1 else 0)
        words[-1] = part - before
    shards = max(1, round(float(row.total) / shard_words))
    return pd.DataFrame({"source": row.source, "source_key": int(row.key), "shard": _shards(j, total, shards, seed ^ int(row.key) & 0x7FFFFFFF), "slot": j, "block_id": ids, "words": words})


def _position(value: int, n: int, key: np.uint64) -> int:
    """Where the permutation puts ``value``: the Feistel rounds run backwards."""
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, x, key, wrap = (1 << half) - 1, value, int(key), (1 << 64) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(3, -1, -1):
            left, right = right, left
            f = (right + key + (r * 0x9E3779B97F4A7C15 & wrap)) * 0xBF58476D1CE4E5B9 & wrap
            f = (f ^ (f >> 29)) * 0x94D049BB133111EB & wrap
            left ^= (f ^ (f >> 32)) & mask
        x = (left << half) | right
        if x < n:
            return x


def _shards(j: np.ndarray, total: int, shards: int, seed: int) -> np.ndarray:
    """The shard of each slot when ``total`` slots fall multinomially into ``shards``: slot ranges in shard order."""
    out = np.empty(len(j), np.int64)

    def split(lo: int, hi: int, first: int, count: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if hi - lo == 1:
            out[at] = lo
            return
        mid = (lo + hi) // 2
        left = int(np.random.default_rng([seed, lo, hi]).binomial(count, (mid - lo) / (hi - lo)))
        low = j[at] < first + left
        split(lo, mid, first, left, at[low])
        split(mid, hi, first + left, count - left, at[~low])

    split(0, shards, 0, total, np.arange(len(j)))
    return out


def mix(docs: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per document sizes and positions, per source targets, pieces).

    Pieces are rows (shard, slot, source, block_id, doc_id, first_word, n_words): what each slot of the mix holds.
    """
    sizes = stage(docs.select("doc_id", "source", count_words(F.col("text")).alias("size")), "mix-sizes")
    plan = stage(targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-plan")
    placed = stage(packed(sizes), "mix-placed")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    slots = draw_slots(plan.withColumn("total", F.lit(total)), block, shard_words)
    parts = placed.where("size > 0").select("doc_id", "source", "start", "size", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))).alias("block_id"))
    lo, hi = F.greatest(F.col("start"), F.col("block_id") * block), F.least(F.col("start") + F.col("size"), (F.col("block_id") + 1) * block)
    parts = parts.select("doc_id", F.xxhash64(null_safe("source"), F.lit(SEED)).alias("source_key"), "block_id", (lo - F.col("block_id") * block).alias("offset"), (lo - F.col("start")).alias("first_word"), (hi - lo).alias("length"))
    # a plan's size doesn't tell how many slots it makes, so Spark mustn't take them for a small table
    pieces = slots.hint("merge").join(parts, ["source_key", "block_id"]).select("shard", "slot", "source", "block_id", "doc_id", "first_word", F.least("length", F.col("words") - F.col("offset")).alias("n_words")).where("n_words > 0")
    return placed, plan, pieces


def document_shares(docs: DataFrame) -> DataFrame:
    """Per document: its size, its source's size and target, and how many of its words the mix takes."""
    placed, plan, pieces = mix(docs)
    taken = pieces.groupBy("doc_id", "source").agg(F.sum("n_words").alias("taken"))
    per_doc = placed.groupBy("doc_id", "source").agg(F.sum("size").alias("size"))
    plan = plan.select(F.col("source").alias("s2"), "source_size", "target")
    out = per_doc.join(taken.withColumnRenamed("doc_id", "d2").withColumnRenamed("source", "s3"), F.col("doc_id").eqNullSafe(F.col("d2")) & F.col("source").eqNullSafe(F.col("s3")), "left")
    out = out.join(plan, F.col("source").eqNullSafe(F.col("s2")))
    return out.select("doc_id", "source", "size", "source_size", F.col("target").cast("double"), F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_text(docs: DataFrame) -> DataFrame:
    """The mix with its words: rows (shard, slot, source, block_id, doc_id, first_word, n_words, text).

    A document's pieces are gathered first, at most three times its length in all, so that its text is split once.
    """
    _, _, pieces = mix(docs)
    fields = ["shard", "slot", "source", "block_id", "first_word", "n_words"]
    per_doc = pieces.groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("pieces"))
    words = docs.select("doc_id", words_of(F.col("text")).alias("words")).join(per_doc, "doc_id")
    cut = let(F.col("words"), lambda w: F.transform("pieces", lambda p: F.struct(*(p[c].alias(c) for c in fields), F.array_join(F.slice(w, p["first_word"].cast("int") + 1, p["n_words"].cast("int")), " ").alias("text"))))
    return words.select("doc_id", F.explode(cut).alias("p")).select("p.shard", "p.slot", "p.source", "p.block_id", "doc_id", "p.first_word", "p.n_words", "p.text")
