"""Operator 2, language identification by word-first backoff.

Each known word scores per language by its log frequency there. An unseen word falls back to the character n-grams
of the padded word, longest first; each n-gram that is unseen falls back to its own next shorter tail, whose score counts ``BACKOFF``
times as much. A text's language
is the one with the greatest sum over its words.

The model is fitted on a bounded, hash-ordered sample of labelled documents (``max_docs``, a parameter) and its
tables hold all words and n-grams that occur twice there, so what the driver holds doesn't grow with the
corpus. Every text is scored whole.

Null text or a text without a letter: ``und``, score 0. No labelled rows: ``und`` everywhere. Null languages are not
learned from. Repeated rows, ties (first language by name) and extra columns give one defined result a row.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LETTERS = re.compile(r"[^\W\d_]+")
MAX_N, BACKOFF = 4, 0.4


def held_out(doc_id: Column, parts: int, rest: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == rest, F.lit(False))


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(max(1, len(padded) - n + 1))]


class Model:
    def __init__(self, rows: Iterator[tuple[str, str]]) -> None:
        words: dict[str, Counter] = defaultdict(Counter)
        for text, lang in rows:
            words[lang].update(LETTERS.findall(text.lower()))
        self.langs = sorted(lang for lang in words if words[lang])
        totals = [sum(words[x].values()) for x in self.langs]
        every = Counter()
        for x in self.langs:
            every.update(words[x])
        log = lambda counts, totals, v: tuple(math.log((c + 0.1) / (t + 0.1 * v)) for c, t in zip(counts, totals, strict=True))
        self.words = {w: log([words[x][w] for x in self.langs], totals, len(every)) for w, c in every.items() if c > 1}
        self.grams: list[dict[str, tuple[float, ...]]] = [{} for _ in range(MAX_N + 1)]
        for n in range(1, MAX_N + 1):
            by = [Counter() for _ in self.langs]
            for k, x in enumerate(self.langs):
                for w, c in words[x].items():
                    for g in grams(w, n):
                        by[k][g] += c
            total = sum(by, Counter())
            sums = [sum(c.values()) for c in by]
            self.grams[n] = {g: log([c[g] for c in by], sums, len(total)) for g, c in total.items() if c > 1}

    def word(self, w: str) -> tuple[float, ...]:
        """Log scores per language, less their greatest: known words directly, others by n-grams, longest first."""
        known = self.words.get(w)
        if known is None:
            found = [self.tail(g) for g in grams(w, MAX_N)]
            known = tuple(sum(x) / len(found) for x in zip(*found, strict=True))
        top = max(known)
        return tuple(x - top for x in known)

    def tail(self, gram: str) -> tuple[float, ...]:
        """Scores of the longest known tail of ``gram``, less their greatest, each step down weighing BACKOFF as much."""
        weight = 1.0
        while gram:
            known = self.grams[len(gram)].get(gram)
            if known:
                top = max(known)
                return tuple(weight * (x - top) for x in known)
            gram, weight = gram[1:], weight * BACKOFF
        return (0.0,) * len(self.langs)

    def predict(self, text: str | None, cache: dict) -> tuple[str, float]:
        counts = Counter(LETTERS.findall((text or "").lower()))
        if not counts or not self.langs:
            return "und", 0.0
        sums = [0.0] * len(self.langs)
        for w, c in counts.items():
            s = cache.get(w)
            if s is None:
                s = self.word(w)
                if len(cache) < 200_000:
                    cache[w] = s
            for k, x in enumerate(s):
                sums[k] += c * x
        mean = np.array(sums) / max(1.0, math.sqrt(counts.total()))
        p = np.exp(mean - mean.max())
        k = int(mean.argmax())
        return self.langs[k], float(p[k] / p.sum())


def fit(docs: DataFrame, max_docs: int = 4000) -> Model:
    """Learn from at most ``max_docs`` distinct texts with a language, those with the least hashes.

    The cut is found among hashes alone, so that only the chosen texts move.
    """
    rows = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    cut = rows.select("h").distinct().orderBy("h").limit(max_docs).agg(F.max("h")).first()[0]
    if cut is None:
        return Model(iter(()))
    chosen = rows.where(F.col("h") <= cut).groupBy("h").agg(F.min("text").alias("text"), F.min("lang").alias("lang")).collect()
    return Model(((r.text, r.lang) for r in sorted(chosen, key=lambda r: r.h)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, lang_pred, score (the winner's share of tempered likelihood)."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        own = cloudpickle.loads(shared.value)
        for batch in texts:
            yield pd.DataFrame([own.predict(t, cache) for t in batch], columns=["lang_pred", "score"])

    return docs.select("doc_id", predict("text").alias("found")).select("doc_id", "found.lang_pred", "found.score")
