"""Operator 3, document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad; its features come from the line itself and from its neighbours. Forward-backward
gives each line's marginal of being good; their mean weighted by line length is calibrated into the document's score.

Labels exist per document, so in fitting every line takes its document's label (the chain then learns how labels
persist from line to line). The fit uses at most ``max_docs`` labelled rows, hash-ordered; that bound is a parameter.
Every text is scored whole.

Null and empty texts: one empty line, scored like others. No labelled rows: score 0.5. Documents with several or no
labels, ties, repeated rows and extra columns are fine; null labels are not learned from.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>@~^=_{}\[\]\\]")
N_OWN = 14


def line_features(line: str) -> list[float]:
    """Measures of one line, each roughly within 0..1."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return [1.0] + [0.0] * (N_OWN - 1)
    letters = size - len(re.findall(r"[\W\d_]", line))
    upper = len(re.findall(r"[A-ZÀ-Þ]", line))
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    symbols = len(SYMBOL.findall(line))
    return [
        0.0,
        min(1.0, np.log1p(n) / 8),
        min(1.0, 10 * symbols / size),
        upper / max(1, letters),
        min(1.0, 5 * len(re.findall(r"\d", line)) / size),
        1 - letters / size,
        len(set(words)) / n,
        same / n,
        min(1.0, (size / n) / 20),
        float(line.rstrip().endswith((".", "?", "!", '"', ":"))),
        min(1.0, 5 * line.count("!") / n),
        min(1.0, 2 * (line.count("|") + line.count(" > ")) / n),
        float("http" in line or "www." in line or "@" in line),
        float(n < 4),
    ]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x features with bias, own, previous, next and repetition; line lengths)."""
    lines = (text or "").split("\n")
    cache: dict[str, list[float]] = {}
    own = np.array([cache.get(x) or cache.setdefault(x, line_features(x)) for x in lines])
    seen: set[str] = set()
    again = np.array([[float(x in seen or bool(seen.add(x)))] for x in lines])  # type: ignore[func-returns-value]
    edge = np.zeros((1, own.shape[1]))
    before, after = np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge])
    x = np.hstack([np.ones((len(lines), 1)), own, own**2, before, after, again])
    return x, np.array([max(1, len(line)) for line in lines], float)


def forward_backward(u: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (n x 2), summed pair marginals (2 x 2) and log partition of a chain with scores u and transitions t."""
    n = len(u)
    e, shift = np.exp(u - u.max(1, keepdims=True)), u.max(1).sum()
    m = np.exp(t)
    a, b, c = np.empty((n, 2)), np.ones((n, 2)), np.empty(n)
    a[0] = e[0]
    c[0] = a[0].sum()
    a[0] /= c[0]
    for i in range(1, n):
        a[i] = (a[i - 1] @ m) * e[i]
        c[i] = a[i].sum()
        a[i] /= c[i]
    for i in range(n - 2, -1, -1):
        b[i] = m @ (e[i + 1] * b[i + 1]) / c[i + 1]
    pairs = np.zeros((2, 2))
    if n > 1:
        pairs = np.einsum("ij,ik,jk->jk", a[:-1], e[1:] * b[1:] / c[1:, None], m)
    return a * b, pairs, float(np.log(c).sum() + shift)


class Crf:
    def __init__(self, rows: list[tuple[str | None, int]], rounds: int = 60, rate: float = 0.1, ridge: float = 1e-4) -> None:
        data = [(features(t)[0], int(y)) for t, y in rows]
        self.known = len({y for _, y in data}) == 2
        self.w, self.t, self.at, self.steep = np.zeros((2, data[0][0].shape[1] if data else 1)), np.zeros((2, 2)), 0.5, 1.0
        if not self.known:
            return
        share = np.mean([y for _, y in data])
        cost = {1: 0.5 / share, 0: 0.5 / (1 - share)}  # both classes weigh the same, whatever their numbers
        moments = [np.zeros_like(self.w), np.zeros_like(self.t), np.zeros_like(self.w), np.zeros_like(self.t)]
        for step in range(1, rounds + 1):
            gw, gt = -ridge * self.w * len(data), -ridge * self.t * len(data)
            for x, y in data:
                p, pairs, _ = forward_backward(x @ self.w.T, self.t)
                gap = -p
                gap[:, y] += 1
                k = cost[y] / len(x)
                gw += k * gap.T @ x
                gt -= k * pairs
                gt[y, y] += k * (len(x) - 1)
            for j, (v, g) in enumerate(((self.w, gw / len(data)), (self.t, gt / len(data)))):
                moments[j] = 0.9 * moments[j] + 0.1 * g
                moments[j + 2] = 0.99 * moments[j + 2] + 0.01 * g * g
                v += rate * (moments[j] / (1 - 0.9**step)) / (np.sqrt(moments[j + 2] / (1 - 0.99**step)) + 1e-8)
        self._calibrate([(self.raw(t), y) for t, y in rows])

    def _calibrate(self, found: list[tuple[float, int]]) -> None:
        """A logistic curve in the raw score, so that 0.3 splits where the errors of both classes balance."""
        raw, y = np.array([r for r, _ in found]), np.array([y for _, y in found])
        cuts = np.unique(np.quantile(raw, np.linspace(0, 1, 401)))
        cuts = np.concatenate([[0.0], (cuts[1:] + cuts[:-1]) / 2, [1.0]]) if len(cuts) > 1 else np.array([0.5])
        good = [(np.mean(raw[y == 1] >= c) + np.mean(raw[y == 0] < c), c) for c in cuts]
        best = [c for g, c in good if g >= max(good)[0] - 1e-12]
        self.at, self.steep = float(np.mean([best[0], best[-1]])), 12.0

    def raw(self, text: str | None) -> float:
        x, size = features(text)
        p = forward_backward(x @ self.w.T, self.t)[0][:, 1]
        return float((p * size).sum() / size.sum())

    def score(self, text: str | None) -> float:
        if not self.known:
            return 0.5
        return float(1 / (1 + np.exp(-self.steep * (self.raw(text) - self.at) + np.log(7 / 3))))

    def line_marginals(self, text: str | None) -> list[float]:
        x, _ = features(text)
        return [float(p) for p in forward_backward(x @ self.w.T, self.t)[0][:, 1]]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 3000) -> Crf:
    """Learn from at most ``max_docs`` labelled documents: up to half from each class, those with the least id hash.

    The ids are chosen among the labels alone, so that only chosen texts move; there are at most ``max_docs`` to broadcast.
    """
    some = labels.where("quality in (0, 1)").select("doc_id", "quality", F.xxhash64("doc_id", F.lit(3)).alias("h"))
    least = [some.where(F.col("quality") == y).orderBy("h", "doc_id").limit(max_docs // 2) for y in (0, 1)]
    rows = docs.select("doc_id", "text").join(F.broadcast(least[0].union(least[1])), "doc_id").select("text", "quality", "h").collect()
    return Crf([(r.text, r.quality) for r in sorted(rows, key=lambda r: (r.h, r.quality))])


def score_column(docs: DataFrame, model: Crf) -> Column:
    """The score of ``docs.text``, whole, from Arrow batches."""
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = cloudpickle.loads(shared.value)
        for batch in texts:
            yield pd.Series([own.score(t) for t in batch], dtype=float)

    return score(docs["text"])


def keep_good(docs: DataFrame, model: Crf, least: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score is below ``least``: one narrow pass, all columns kept."""
    return docs.where(score_column(docs, model) >= least)
