"""Operator 7, a grouped prefix join on n-gram Jaccard similarity.

A document's set are the 64-bit hashes of its distinct word n-grams. Tokens are ordered rarest class first: tokens
that few documents have, then those whose frequency isn't counted, then frequent ones; in a class by hash. Any fixed
order gives an exact prefix filter; this one keeps passages that many documents share out of the prefixes.
Documents of identical sets collapse into one, documents with identical prefixes and size into one group; groups
that share a prefix token are filtered by size, position and parity bitmap, expanded to members and verified on whole
sets. A bitmap has the parity of the number of tokens per cell; two differ in at most as many bits as the sets differ
in tokens, so the filter loses no link.

Frequencies are counted over all documents, for the 3/16 of all tokens with the least hashes: prefixes come from
there unless most of a document is frequent. The list of frequent tokens is broadcast; its length is checked, and
the threshold doubles until it is at most ``MAX_FREQUENT``. That changes the order, hence the work, never the result.

Null and empty texts: an empty set, linked with nothing. Texts with fewer words than n: one shingle. Repeated rows
collapse. Ties don't arise: tokens are ordered by hash. doc_ids are taken to be unique; a row with a null one joins nothing of
its own: it takes the component of an equal set, else null. Extra columns
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm import linking
from strandlab.llm.common import drop_staged, fresh_key, stage

FREQUENT, MAX_FREQUENT, LOW, CELLS, MAX_BROADCAST_IDS = 8, 2_000_000, np.uint64(3 << 60), 512, 2_000_000
BITS = [f"b{k}" for k in range(CELLS // 64)]
_rng = np.random.default_rng(20240101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {0: (np.ones(1, np.uint64), np.ones(1, np.uint64))}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0][0]) < n:
        m = 1 << (n - 1).bit_length()
        up, down = np.full(m, _BASE, np.uint64), np.full(m, _INVERSE, np.uint64)
        up[0] = down[0] = 1
        _powers[0] = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    return _powers[0]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and how many words each text has: prefix sums of a rolling hash, no loop over words."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    gap = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    last = np.cumsum([len(r) + 1 for r in raw])
    return hashes, np.diff(np.concatenate([[0], np.searchsorted(starts, last)]))


def shingle_sets(texts: list[str | None], n: int = 4, chunk: int = 1 << 20) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size < chunk):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        hashes, counts = word_hashes(part)
        if len(hashes) >= n:
            m = len(hashes) - n + 1
            rolled = np.zeros(m, np.uint64)
            for k in range(n):
                rolled = mix(rolled + hashes[k : k + m] + np.uint64(k + 1))
        first = 0
        for c in counts.tolist():
            if c >= n:
                yield np.unique(rolled[first : first + c - n + 1])
            elif c:
                short = np.uint64(c * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
                with np.errstate(over="ignore"):
                    for h in hashes[first : first + c]:
                        short = mix(np.array([short + h + np.uint64(77)], np.uint64))[0]
                yield np.array([short], np.uint64)
            else:
                yield np.zeros(0, np.uint64)
            first += c
        at = end


def prefix_size(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1


def frequent_tokens(docs: DataFrame, n: int, least: int = FREQUENT, limit: int = MAX_FREQUENT) -> np.ndarray:
    """Tokens of the counted range that at least ``least`` documents have; ``least`` doubles until ``limit`` suffices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[: np.searchsorted(s, LOW)] for s in shingle_sets(batch.column(0).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))], ["token"])

    counts = docs.select("text").mapInArrow(run, "token long").groupBy("token").count()
    counts = stage(counts.where(F.col("count") >= least), "frequent")
    while counts.where(F.col("count") >= least).count() > limit:
        least *= 2
    rows = counts.where(F.col("count") >= least).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def sketches(docs: DataFrame, frequent: np.ndarray, n: int, percent: int) -> DataFrame:
    """(doc_id, size, set_a, set_b, prefix_key, prefix, bits): two hashes of the whole set, one of the ordered prefix, the prefix, the bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            rows, bits = [], []
            for s in shingle_sets(batch.column(1).to_pylist(), n):
                low = np.searchsorted(s, LOW)
                is_often = np.zeros(low, bool)
                if len(often):
                    where = np.minimum(np.searchsorted(often, s[:low]), len(often) - 1)
                    is_often = often[where] == s[:low]
                order = np.concatenate([s[:low][~is_often], s[low:], s[:low][is_often]])[: prefix_size(len(s), percent) if len(s) else 0]
                mixed = mix(s + np.uint64(1))
                odd = np.bincount((mixed & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
                rows.append((len(s), mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed, initial=np.uint64(0)), mix(order * np.uint64(3) + np.uint64(5)).sum(dtype=np.uint64), order.view(np.int64)))
            ints = [pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in range(4)]
            lists = pa.array([r[4] for r in rows], pa.list_(pa.int64()))
            words = np.array(bits, np.int64).reshape(-1, len(BITS))
            parity = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(len(BITS))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *ints, lists, *parity], ["doc_id", "size", "set_a", "set_b", "prefix_key", "prefix", *BITS])

    schema = "doc_id long, size long, set_a long, set_b long, prefix_key long, prefix array<long>, " + ", ".join(f"{b} long" for b in BITS)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(id, set): the whole sets of some documents as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1).to_pylist(), n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["id", "set"])

    ids = stage(ids.select(F.col("id").alias("doc_id")), "ids")
    ids = F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids
    chosen = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi")
    return chosen.mapInArrow(run, "id long, set binary").dropDuplicates(["id"])


def join_similar(docs: DataFrame, n: int = 4, percent: int = 85) -> tuple[DataFrame, DataFrame | None, list[DataFrame]]:
    """(classes, labels, links): classes are (doc_id, n_shingles, rep), rep being the least id of equal sets;
    labels (id, label) are components of reps; links (a, b) are verified pairs of reps that connect them."""
    docs = docs.select("doc_id", "text")
    drawn = stage(sketches(docs, frequent_tokens(docs, n), n, percent), "sketches")
    same = F.struct("size", "set_a", "set_b")
    reps = drawn.where("size > 0 and doc_id is not null").groupBy("size", "set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    keyed = drawn.select("doc_id", "size", fresh_key(same).alias("key"))
    classes = stage(keyed.join(reps.select(fresh_key(same).alias("key"), "rep"), "key", "left").select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep")), "classes")
    heads = stage(drawn.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "heads")
    drop_staged(drawn)
    # groups of reps with the same prefix and size; only one of a group's prefixes is dealt out by token
    groups = stage(heads.groupBy("size", "prefix_key").agg(F.min("doc_id").alias("gid"), F.count(F.lit(1)).alias("n")), "groups")
    tokens = heads.join(groups.select(F.col("gid").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("gid"), F.posexplode("prefix").alias("at", "key"))
    shared = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    tokens = tokens.join(shared, "key")
    several = groups.where("n > 1").select("size", "prefix_key", "gid")
    inside = heads.select("doc_id", "size", "prefix_key").join(several, ["size", "prefix_key"])
    inside = stage(inside.select("gid", F.col("doc_id").alias("id")), "inside")
    expanded = tokens.join(inside, "gid", "left").select("key", F.coalesce("id", "gid").alias("id"), "at")
    # members of a group meet through a bucket of their own, at place -1, which passes every filter
    expanded = expanded.union(inside.select(F.xxhash64("gid", F.lit(9)), "id", F.lit(-1)))
    members = stage(expanded.join(heads.select(F.col("doc_id").alias("id"), "size", *BITS), "id"), "buckets")
    drop_staged(heads)

    need = lambda x, y: F.ceil((F.col(f"{x}size") + F.col(f"{y}size")) * percent / (100 + percent) - 1e-9)
    ahead = lambda p, at: F.col(f"{p}size") - F.col(at) - 1

    def promising(x: str, y: str) -> Column:
        fits = (100 * F.least(f"{x}size", f"{y}size")) >= percent * F.greatest(f"{x}size", f"{y}size")
        apart = sum((F.bit_count(F.col(x + b).bitwiseXOR(F.col(y + b))) for b in BITS[1:]), F.bit_count(F.col(x + BITS[0]).bitwiseXOR(F.col(y + BITS[0]))))
        alike = 2 * need(x, y) <= F.col(f"{x}size") + F.col(f"{y}size") - apart
        return fits & alike & (F.least(f"{x}at", f"{y}at") + 1 + F.least(ahead(x, f"{x}at"), ahead(y, f"{y}at")) >= need(x, y))

    def may_link(pairs: DataFrame) -> DataFrame:
        out = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.max("a_at").alias("a_last"), F.max("b_at").alias("b_last"), F.min("a_at").alias("least"), F.first("a_size").alias("a_size"), F.first("b_size").alias("b_size"))
        return out.where((F.col("least") < 0) | (F.col("shared") + F.least(ahead("a_", "a_last"), ahead("b_", "b_last")) >= need("a_", "b_")))

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
        sets = stage(sets_of(docs, ids, n), "sets")
        one = pairs.withColumn("key", fresh_key(F.col("a"))).join(sets.select(fresh_key(F.col("id")).alias("key"), F.col("set").alias("set_a")), "key")
        two = one.select("a", "b", "set_a", fresh_key(F.col("b")).alias("key")).join(sets.select(fresh_key(F.col("id")).alias("key"), F.col("set").alias("set_b")), "key")

        @F.pandas_udf("boolean")
        def link(x: pd.Series, y: pd.Series) -> pd.Series:
            def one(p: bytes, q: bytes) -> bool:
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                return 100 * both >= percent * (len(p) + len(q) - both)

            return pd.Series([one(p, q) for p, q in zip(x, y, strict=True)], dtype=bool)

        return two.where(link("set_a", "set_b")).select("a", "b")

    labels, links = linking.connect(members, ["size", "at", *BITS], promising, may_link, verify)
    return classes, labels, links


def components(docs: DataFrame, n: int = 4, percent: int = 85) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    classes, labels, _ = join_similar(docs, n, percent)
    if labels is None:
        return classes.select("doc_id", "n_shingles", F.col("rep").alias("component_id"))
    up = labels.select(fresh_key(F.col("id")).alias("key"), "label")
    return classes.withColumn("key", fresh_key(F.col("rep"))).join(up, "key", "left").select("doc_id", "n_shingles", F.coalesce("label", "rep").alias("component_id"))
