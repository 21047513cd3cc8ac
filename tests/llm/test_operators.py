"""The training-data operators against brute force on small awkward tables."""

import base64
import collections
import hashlib
import re

import pytest

from strandlab.llm import decontaminate, language_id, licenses, line_dedup, mixing, ngram_join, quality_crf, quality_rules, url_filters, warc
from strandlab.llm.common import new_path

from .fixtures import PROSE, docs, empty, rows

WORD, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_warc_round_trip(spark):
    html = [None, "", "<p>x</p>", "<p>x</p>", "é" * 10, "<p>x</p>", "y" * (17 << 20)]
    pages = spark.createDataFrame([(k, None if k == 2 else f"http://h/{k}", h, "c") for k, h in enumerate(html)] + [(2, None, "<p>x</p>", "c")], "page_id long, url string, html string, payload string")
    path = new_path(spark, "warc-test")
    warc.write_archive(pages, path)
    for split in (64, 8 << 20):
        if split == 64:
            small = new_path(spark, "warc-test")
            warc.write_archive(pages.where("page_id < 6"), small)
            got = warc.read_archive(spark, small, split).collect()
            assert len(got) == 7
        else:
            got = warc.read_archive(spark, path, split).collect()
            assert len(got) == 8
        first = {}
        for k, h in enumerate(html):
            first.setdefault((h or "").encode(), k)
        for r in got:
            data = (html[r.page_id] or "").encode()
            assert r.payload_bytes == len(data)
            assert r.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
            own = first[data] == r.page_id
            assert (r.record_type, r.refers_to) == (("response", None) if own else ("revisit", first[data]))


def test_warc_ignores_false_magic(spark, tmp_path):
    import random

    noise = random.Random(5).randbytes(3000)
    payload = (noise + b"\x1f\x8b\x08\x00" + noise).decode("latin-1")
    record = warc.member(warc.record(1, "u", payload.encode("utf-8"), None))
    (tmp_path / "a").write_bytes(b"\x1f\x8b\x08junk" + record + b"\x1f\x8b\x08" + record)
    got = warc.read_archive(spark, f"file://{tmp_path}", 100).collect()
    assert [r.payload_bytes for r in got] == [len(payload.encode())] * 2


def test_warc_empty(spark):
    path = new_path(spark, "warc-test")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


def test_language(spark, sf):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit(table)
    got = {r.doc_id: r for r in language_id.identify(table, model).collect()}
    truth = {r.doc_id: r.lang for r in table.collect()}
    assert sum(got[k].lang_pred == v for k, v in truth.items()) >= 0.95 * len(truth)
    odd = {r.doc_id: r for r in language_id.identify(docs(spark), model).collect()}
    assert len(odd) == len(rows()) and odd[1].lang_pred == odd[2].lang_pred == odd[3].lang_pred == "und" and odd[1].score == 0
    assert all(0 <= r.score <= 1 for r in odd.values())
    none = language_id.identify(docs(spark), language_id.fit(empty(spark))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert language_id.identify(empty(spark), model).count() == 0


def test_quality_crf(spark, sf):
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_crf.fit(table, labels, 60)
    got = {r.doc_id: r.s for r in table.select("doc_id", quality_crf.score_column(table, model).alias("s")).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert sum((got[k] >= 0.3) == bool(v) for k, v in truth.items()) >= 0.9 * len(truth)
    odd = docs(spark)
    assert all(0 <= r[0] <= 1 for r in odd.select(quality_crf.score_column(odd, model)).collect())
    assert quality_crf.keep_good(odd, model).columns == odd.columns
    assert quality_crf.keep_good(empty(spark), model).count() == 0
    assert quality_crf.fit(table, labels.where("quality > 5")).score("x") == 0.5


def test_crf_marginals_by_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(0)
    u, t = rng.normal(size=(5, 2)), rng.normal(size=(2, 2))
    p, pairs, logz = quality_crf.forward_backward(u, t)
    weight = {y: np.exp(sum(u[i, k] for i, k in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:]))) for y in itertools.product((0, 1), repeat=5)}
    z = sum(weight.values())
    assert np.isclose(logz, np.log(z))
    assert np.allclose(p[:, 1], [sum(w for y, w in weight.items() if y[i]) / z for i in range(5)])
    assert np.allclose(pairs, [[sum(w * sum((y[i], y[i + 1]) == (a, b) for i in range(4)) for y, w in weight.items()) / z for b in (0, 1)] for a in (0, 1)])


def test_url_filters(spark):
    import datetime as dt

    day = lambda d: dt.datetime(2024, 1, d)
    entries = spark.createDataFrame([("a", "bad.com", "add", day(3)), ("a", "bad.com", "add", day(4)), ("a", "bad.com", "remove", day(10)), ("a", "bad.com", "add", day(20)), ("b", "x.org/p/q", "add", day(1)), ("c", None, "add", day(1)), ("c", "z.com", None, day(1)), ("d", "z.com", "remove", day(2))], "list string, pattern string, action string, at timestamp")
    urls = [("http://WWW.Bad.com:80/x?y", 2), ("http://www.bad.com/", 3), ("https://u@bad.com", 9), ("http://bad.com/", 10), ("http://notbad.com/", 5), ("http://a.b.bad.com", 25), ("http://x.org/p/q?z", 5), ("http://x.org/p", 5), (None, 5), ("nonsense", 5), ("http://z.com", 5)]
    captures = spark.createDataFrame([(k, u, day(d), "clash") for k, (u, d) in enumerate(urls)] + [(11, "http://bad.com", None, "")], "id long, url string, fetched timestamp, lists string")
    got = {r.id: (r.lists, r.n_entries, r.blocked) for r in url_filters.match(captures, entries).collect()}
    hit = {1: "a", 2: "a", 5: "a", 6: "b"}
    assert got == {k: (hit.get(k, ""), int(k in hit), k in hit) for k in range(12)}
    assert url_filters.match(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filters.match(captures.limit(0), entries).count() == 0


def test_quality_rules(spark):
    got = {r.doc_id: r for r in quality_rules.clean_lines(docs(spark)).collect()}
    for i, text, *_ in rows():
        w = WORD.findall(text or "")
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = collections.Counter(grams)
        cover = {k + j for k, g in enumerate(grams) if n[g] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum((text or "").count(s) for s in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.clean_lines(empty(spark)).count() == 0


def test_decontamination(spark):
    items = [(0, PROSE), (1, "Quick brown"), (2, None), (3, ""), (10, "word5 tail5 word6 tail6 word7 tail7 word8 tail8 word9 tail9 word10 tail10"), (11, "nowhere " * 12)]
    bench = spark.createDataFrame([(*x, "clash") for x in items], "item_id long, text string, n_words string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs(spark), bench).collect()}
    for i, text, *_ in rows():
        w, hit, found = ALNUM.findall(lower(text)), set(), set()
        for k, t in items:
            v = ALNUM.findall(lower(t))
            size = min(10, len(v))
            wins = {tuple(v[a : a + size]) for a in range(len(v) - size + 1)} if v else set()
            for p in range(len(w) - size + 1):
                if tuple(w[p : p + size]) in wins:
                    hit |= set(range(p, p + size))
                    found.add(str(k))
        r = got[i]
        assert (r.n_words, r.n_hit, r["items"], r.contaminated) == (len(w), len(hit), sorted(found), bool(hit)), i
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(docs(spark), bench.limit(0)).where("contaminated").count() == 0


def brute_components(table, n, percent):
    sets = {}
    for i, text in table:
        w = WORD.findall(lower(text))
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_ngram_join(spark, n, percent):
    import random

    rng = random.Random(n)
    base = [[rng.choice("abcdefghij") + str(rng.randrange(9)) for _ in range(rng.randrange(20, 60))] for _ in range(6)]
    shared = [f"s{k}" for k in range(30)]
    extra = []
    for k in range(60):
        w = list(base[k % 6]) + (shared if k % 3 == 0 else [])
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"z{rng.randrange(99)}"
        extra.append((100 + k, " ".join(w)))
    table = [(i, t) for i, t, *_ in rows()] + extra
    df = docs(spark, [(i, t, None, None, 0, "", 0) for i, t in extra])
    want = brute_components(table, n, percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.components(df, n, percent).collect()}
    assert got == want
    assert ngram_join.components(empty(spark)).count() == 0


def test_line_dedup(spark):
    a = "Seven wizards brew potions near the old stone bridge at dawn every single day of the week in spring"
    extra = [(20, a + "\nshort line\n" + "A fresh line that nobody else has written here"), (21, "short line\n" + a.upper() + "!"), (22, a.replace("week", "weeks") + "\nAnother line which stands alone in this text"), (23, a)]
    df = docs(spark, [(i, t, "en", "s", 0, "w", 9) for i, t in extra])
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines_dropped"]
    got = {r.doc_id: r.text for r in out.collect()}
    assert got[20] == extra[0][1] and got[21] == "short line" and got[23] == "" and got[1] is None and got[2] == ""
    assert got[0] == PROSE + "." and got[4] == "" and got[5] == ""
    assert got[22] in (extra[2][1], "Another line which stands alone in this text")
    assert line_dedup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_finds_near_lines(spark):
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "to") for b in ("den", "fas", "gor", "hul", "jin", "kep")]
    table, want = [], []
    for k in range(20):
        line = [words[(k * 7 + j * (k + 3)) % len(words)] + words[(j + k) % len(words)] for j in range(45)]
        near = [*line[:20], "changed", *line[21:]]
        table += [(2 * k, " ".join(line)), (2 * k + 1, " ".join(near))]
        want.append(2 * k + 1)
    df = spark.createDataFrame(table, "doc_id long, text string")
    gone = {r.doc_id for r in line_dedup.dedup_lines(df).where("n_lines_dropped > 0").collect()}
    assert gone <= set(want) and len(gone) >= 1  # SimHash finds a share of the near lines, and nothing else


def test_simhash_by_brute_force(spark):
    from pyspark.sql import functions as F

    heavy = lambda x: 4 if len(x) > 3 else 1
    df = spark.createDataFrame([(0, "alpha beta gamma delta epsilon beta"), (1, PROSE)], "doc_id long, text string")
    got = {r.doc_id: r.simhash & (1 << 64) - 1 for r in line_dedup.simhash_lines(line_dedup.lines_of(df)).collect()}
    for i, text in ((0, "alpha beta gamma delta epsilon beta"), (1, PROSE)):
        w = text.split()
        hashes = {r.w: r.h & (1 << 64) - 1 for r in spark.createDataFrame([(x,) for x in set(w)], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
        assert got[i] == sum((2 * sum(heavy(x) * (hashes[x] >> k & 1) for x in w) > sum(map(heavy, w))) << k for k in range(64))


def test_licenses(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark)).collect()}
    for i, text, *_ in rows():
        w = ALNUM.findall(lower(text))
        places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r["labels"].split(","))
    scan = licenses.Scanner().scan("intro. This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the FSF")
    assert scan["labels"] == "gpl" and scan["n_base"] == 0 and scan["spans"]
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_suffix_automaton_by_brute_force():
    import random

    rng = random.Random(1)
    seqs = [[rng.choice("abc") for _ in range(rng.randrange(1, 12))] for _ in range(5)]
    sam = licenses.SuffixAutomaton(seqs)
    text = [rng.choice("abcd") for _ in range(300)]
    subs = {tuple(s[i:j]) for s in seqs for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    got = {i: n for i, _, n in sam.matches(text)}
    for i in range(len(text)):
        best = max((n for n in range(1, i + 2) if tuple(text[i + 1 - n : i + 1]) in subs), default=0)
        assert got.get(i, 0) == best
    for v_i, v, n in sam.matches(text):
        own = text[v_i + 1 - n : v_i + 1]
        assert sam.ends[v] == {(k, e) for k, s in enumerate(seqs) for e in range(len(s)) if s[max(0, e + 1 - n) : e + 1] == own}


def test_mix(spark):
    df = docs(spark)
    out = mixing.document_shares(df).collect()
    sizes = collections.Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * level > 3 * sizes[s]}
        if not more:
            break
        full |= more
    taken = collections.Counter()
    for r in out:
        want = 3 * sizes[r.source] if r.source in full else weight[r.source] * level
        assert abs(r.target - want) < 1e-6 and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 1 for r in out) and len(out) == len(rows())
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, mixing.document_shares(df).collect()), key=str)
    assert mixing.document_shares(empty(spark)).count() == 0


def test_mixed_text_holds_the_words(spark):
    texts = {i: WORD.findall(t or "") for i, t, *_ in rows()}
    out = mixing.mixed_text(docs(spark)).collect()
    assert out and all(r.text.split() == [x for x in " ".join(texts[r.doc_id][r.first_word : r.first_word + r.n_words]).split()] for r in out)


def test_permutation():
    import numpy as np

    for n in (1, 2, 3, 65, 1000):
        key = np.uint64(99)
        p = mixing.permute(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(p) == list(range(n)) and all(mixing._position(int(v), n, key) == i for i, v in enumerate(p))


def test_license_near_misses():
    labels = lambda text: licenses.Scanner().scan(text)["labels"]
    assert labels("This work is licensed under the GNU General Public License version 2") == "gpl-2"
    assert labels("This work is licensed under the GNU General Public License version 3") == "gpl-3"
    assert labels("Licensed under CC BY 4.0") == "cc-by" and labels("licensed under CC BY-SA 4.0") == "cc-by-sa"
    assert labels("Licensed under the CC BY-NC 4.0") == "cc-by-nc"


def test_url_filters_path_case(spark):
    import datetime as dt

    at = dt.datetime(2024, 1, 1)
    entries = spark.createDataFrame([("a", "X.org/P/q", "add", at)], "list string, pattern string, action string, at timestamp")
    captures = spark.createDataFrame([(0, "http://x.org/P/q", at), (1, "http://x.org/p/q", at)], "id long, url string, fetched timestamp")
    assert {r.id: r.blocked for r in url_filters.match(captures, entries).collect()} == {0: True, 1: False}


def test_decontamination_of_shared_items(spark):
    bench = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (1, "wizards brew"), (None, "lazy dog")], "item_id long, text string")
    table = spark.createDataFrame([(0, "so one two three go"), (1, "wizards brew"), (2, "the lazy dog"), (3, "one two brew")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.contaminated) for r in decontaminate.contamination(table, bench).collect()}
    assert got == {0: (3, ["1"], True), 1: (2, ["1"], True), 2: (2, [], True), 3: (0, [], False)}


def test_mix_of_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d " * 50, "s"), (1, "e f " * 50, "s"), (None, "g " * 90, "t")], "doc_id long, text string, source string")
    out = mixing.document_shares(df).collect()
    for s in ("s", "t"):
        assert abs(sum(r.taken for r in out if r.source == s) - next(r.target for r in out if r.source == s)) <= 1


def test_mix_over_many_shards(spark):
    _, plan, pieces = mixing.mix(docs(spark), block=16, shard_words=2_000)
    per_shard = collections.Counter()
    for r in pieces.select("shard", "n_words").collect():
        per_shard[r.shard] += r.n_words
    total = sum(r.target for r in plan.collect())
    assert len(per_shard) == round(total / 2_000) and 1.6 * total / len(per_shard) > max(per_shard.values()) and abs(sum(per_shard.values()) - total) <= 10


def test_warc_ranges_run_in_tasks_of_their_own(spark):
    path = new_path(spark, "warc-test")
    pages = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(md5(cast(id as string)), 40) as html")
    warc.write_archive(pages, path)
    got = warc.read_archive(spark, path, 1 << 12)
    assert got.rdd.getNumPartitions() >= 8 and got.count() == 200


def test_language_backoff(spark):
    model = language_id.Model(iter([("abcd abcd xyzw", "p"), ("zzcd zzcd xyzw", "q"), ("abcd qqqq qqqq", "p")]))
    near, far = model.tail("^abc"), model.tail("?abc")
    assert near[0] == 0 and all(abs(f - 0.4 * n) < 1e-9 for f, n in zip(model.tail("?bcd"), model.tail("bcd"), strict=True)) and far != near
    assert model.word("abcd")[0] == 0 and model.word("abcd")[1] < 0


def test_models_travel_without_the_package(spark, tmp_path):
    import subprocess
    import sys

    from pyspark import cloudpickle

    crf = quality_crf.Crf([("good text of many plain words.", 1), ("## || $$ 11", 0)], rounds=2)
    lang = language_id.Model(iter([("le la les le la", "fr"), ("the of the of", "en")]))
    (tmp_path / "m").write_bytes(cloudpickle.dumps((crf, lang)))
    code = "import sys, pickle; a, b = pickle.load(open('m', 'rb')); a.score('x y'); b.predict('the', {}); assert 'strandlab' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60, env={"PATH": "/usr/bin"})


def test_letters_count_alike_at_every_length():
    short, long = quality_crf.line_features("½½ a. "), quality_crf.line_features("½½ a. " * 200)
    assert abs(short[5] - long[5]) < 1e-9
