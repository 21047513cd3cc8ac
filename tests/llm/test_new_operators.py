"""Periodic runs, fill-in-middle and packing against brute force on small awkward tables."""

import collections
import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandlab.llm import fill_middle, packing, periodic_runs, queries

from .fixtures import docs, empty

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_runs(words, min_words=24, times=3):
    """All runs by trying each period: maximal stretches of equal words at distance q, least period kept."""
    best = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            j = i
            while j < n and words[j] == words[j - q]:
                j += 1
            if j - i + q >= 2 * q:
                best.setdefault((i - q, j), q)
            i = j
    return sorted((s, e - s, q) for (s, e), q in best.items() if e - s >= max(min_words, times * q))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.integers(2, 4), st.integers(4, 12))
def test_runs_of_words(words, times, least):
    assert periodic_runs.runs_of(words, least, times) == slow_runs(words, least, times)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), min_size=1, max_size=5), st.integers(1, 8)), max_size=8), st.integers(4, 14))
def test_stretches_hold_every_run(blocks, least):
    words = [w for block, n in blocks for w in block * n]
    texts = [" ".join(words).encode(), b"", b"  \n", b"a a a a", " ".join(words[::-1]).encode()]
    offsets = np.cumsum([0, *map(len, texts)])
    found = periodic_runs.repeated_stretches(np.frombuffer(b"".join(texts), np.uint8), offsets, least - least // 3)
    for k, text in enumerate(texts):
        w = text.split()
        assert [(a + s, n, q) for a, b in found.get(k, ()) for s, n, q in periodic_runs.runs_of(w[a:b], least)] == slow_runs(w, least)


def test_large_end_position_sets():
    words = ["a"] * 5000 + ["b"] + ["a", "c"] * 2000
    assert periodic_runs.runs_of(words) == [(0, 5000, 1), (5001, 4000, 2)]


def periodic_docs(spark):
    rng = random.Random(3)
    extra = [(100 + k, " ".join(rng.choice("abcdefgh") for _ in range(7)) * 1 + " " + " ".join(["x y z w"] * k), "en", "a", 0, "clash", -1) for k in range(12)]
    extra += [(7, "t\x0bu\x0cv\r" * 20, None, None, 0, "c", 0), (7, "t\x0bu\x0cv\r" * 20, None, None, 0, "c", 0), (None, "k \x85 \xa0 " * 30, None, None, 0, "c", 0), (None, None, None, None, 0, "c", 0)]
    return docs(spark, extra)


def test_periodic_runs(spark, tmp_path):
    d = periodic_docs(spark)
    path = f"file://{tmp_path}"
    d.repartition(3).write.parquet(path + "/documents.parquet")
    got = queries.op11_periodic_runs(spark, path).collect()
    want = collections.Counter()
    for r in d.collect():
        words = WORD.findall(r.text or "")
        h = zlib.crc32(str(r.doc_id).encode() if r.doc_id is not None else b"")
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = slow_runs(words) if n < 2000 else periodic_runs.runs_of(words)
        gone = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want[r.doc_id, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    assert sum(r.n_runs > 0 for r in got) > 8
    found = periodic_runs.find_runs(empty(spark))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and found.count() == 0
    with pytest.raises(ValueError, match="times"):
        periodic_runs.find_runs(d, times=1)


def slow_cut(doc_id, text, seed=1, percent=90, suffix_first=20):
    t = text or ""
    x = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(t), "plain", None, None, t
    if h[3] % 100 < suffix_first:
        return len(t), "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return len(t), "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


def test_fill_in_middle(spark):
    from pyspark.sql import functions as F

    extra = [(k, "<P<S<M" * (k % 5) + ("a\n\x00é漢𝒳>" * (k % 7)), "en", "a", 0, "clash", -1) for k in range(20, 120)]
    extra += [(k, "x <S> y", "en", "a", 0, "c", 0) for k in range(200, 210)] + [(None, "some text", None, None, 0, "c", 0), (4, "another text under one id", None, None, 0, "c", 0), (300, "é" * 3_000_000, "en", "a", 0, "c", 0)]
    d = docs(spark, extra)
    got = fill_middle.fill_in_middle(d.withColumn("form", F.lit("clash"))).withColumn("text", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.text) for r in got) == collections.Counter((r.doc_id, *slow_cut(r.doc_id, r.text), r.text or "") for r in d.collect())
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    some = fill_middle.fill_in_middle(docs(spark), seed=5, percent=100, suffix_first=50).collect()
    assert sorted((r.doc_id, r.output) for r in some) == sorted((r.doc_id, slow_cut(r.doc_id, r.text, 5, 100, 50)[-1]) for r in docs(spark).collect())
    assert fill_middle.fill_in_middle(empty(spark)).count() == 0


@functools.cache
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def whole_ids(texts):
    return [e.ids + [0] for e in tokenizer().encode_batch(texts, add_special_tokens=False)]


@functools.cache
def encoder():
    return packing.Encoder(packing.VOCABULARY)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r\x0b\x1c\x85\xa0 　ab'sé漢1.!<|>\x00", max_size=30), min_size=1, max_size=5))
def test_ids_equal_those_of_tokenizers(texts):
    assert [list(np.frombuffer(encoder().encode(t), "<u4")) + [0] for t in texts] == whole_ids(texts)


def test_ids_of_the_table_equal_those_of_tokenizers(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["<|endoftext|> x", "a" * 100_000, " " * 50_000 + "b", "漢" * 20_000]
    assert [list(np.frombuffer(encoder().encode(t), "<u4")) + [0] for t in texts] == whole_ids(texts)


def slow_best_fit(lengths, capacity):
    """Rooms left after best fit decreasing, one piece at a time."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = min((k for k, r in enumerate(rooms) if r >= n), key=lambda k: rooms[k], default=None)
        if fit is None:
            rooms.append(capacity - n)
        else:
            rooms[fit] -= n
    return sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.just(40))
def test_plan_is_best_fit_decreasing(lengths, capacity):
    counts = collections.Counter(lengths)
    used, ranks = collections.defaultdict(list), collections.defaultdict(list)
    for length, rank, each, first, n, offset in packing.plan(counts, capacity):
        ranks[length].extend(range(rank, rank + n * each))
        for b in range(first, first + n):
            used[b] += [(offset + k * length, length) for k in range(each)]
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    assert sorted(capacity - sum(m for _, m in parts) for parts in used.values()) == slow_best_fit(lengths, capacity)


def test_packing(spark):
    extra = [(k, "same length here", "en", "a", 0, "clash", -1) for k in range(50, 250)] + [(None, "no id", None, None, 0, "c", 0), (4, "another text under one id", None, None, 0, "c", 0), (None, "no id", None, None, 0, "c", 0)]
    d = docs(spark, extra).repartition(5)
    packed = packing.pack(d, capacity=256, keep_ids=True).cache()
    rows, texts = packed.collect(), [(r.doc_id, r.text or "") for r in docs(spark, extra).collect()]
    want = collections.Counter()
    for (doc_id, _), ids in zip(texts, whole_ids([t for _, t in texts]), strict=True):
        first = len(ids) % 256 or min(len(ids), 256)
        for j, start in enumerate([0, *range(first, len(ids), 256)]):
            part = ids[start : first if j == 0 else start + 256]
            want[doc_id, j, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 256
    assert len(bins) == len(slow_best_fit([k[3] for k in want.elements()], 256))
    made = packing.sequences(packed).collect()
    assert {r.sequence_id: r.n_tokens for r in made} == {k: sum(n for _, n in v) for k, v in bins.items()}
    assert all(len(r.ids) == 4 * r.n_tokens for r in made)
    assert packing.pack(empty(spark)).count() == 0
