"""Operator 9, licence scans with a generalised suffix automaton of licence tokens.

The automaton holds every substring of the templates and phrases. A document's words stream through it once and give
matching statistics: per word, the longest template substring that ends there. Right-maximal long matches are
chained per template, in document and template order with bounded gaps, and the words a chain covers are the
template's span. Phrases are places where the matched string has the phrase as a suffix, read off the automaton's
suffix links.

The automaton's size depends on the templates alone. A document is streamed by one task; its matches are bounded by
its length. Null and empty texts: no words, no labels, score 0. Repeated rows, ties, empty tables and extra columns
need no special case: rows are independent.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The phrases of the contract and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Opening sentences of public licence texts and notices, as words, and their labels.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit", "released under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2", "this work is licensed under the gnu general public license version 2"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]
# Words that a label's spans must hold side by side, since its templates differ from another label's in these alone.
REQUIRED = {"mit": ("mit license", "hereby granted free of charge"), "gpl-3": ("license version 3",), "gpl-2": ("license version 2",), "cc-by-nc": ("by nc",), "cc-by-sa": ("by sa",), "cc-by": ("by 4", "attribution 4")}
MIN_MATCH, MAX_GAP, MIN_COVER = 3, 8, 0.6
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


class SuffixAutomaton:
    """All substrings of several token sequences; each state knows where in the sequences its strings end."""

    def __init__(self, sequences: list[list[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[set[tuple[int, int]]] = [set()]
        for k, tokens in enumerate(sequences):
            last = 0
            for i, token in enumerate(tokens):
                last = self._extend(last, token)
                self.ends[last].add((k, i))
        for v in sorted(range(1, len(self.length)), key=lambda v: -self.length[v]):
            if self.link[v] > 0:
                self.ends[self.link[v]] |= self.ends[v]

    def _state(self, length: int, link: int, arrows: dict[str, int]) -> int:
        self.next.append(arrows)
        self.length.append(length)
        self.link.append(link)
        self.ends.append(set())
        return len(self.length) - 1

    def _split(self, p: int, token: str) -> int:
        q = self.next[p][token]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(token) == q:
            self.next[p][token] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, token: str) -> int:
        if token in self.next[last]:
            return self._split(last, token)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and token not in self.next[p]:
            self.next[p][token] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, token)
        return new

    def state_of(self, tokens: list[str]) -> int:
        v = 0
        for t in tokens:
            v = self.next[v][t]
        return v

    def matches(self, words: list[str]) -> Iterator[tuple[int, int, int]]:
        """(end index, state, length) per word where some template substring ends."""
        v, size, nxt, link, length = 0, 0, self.next, self.link, self.length
        for i, w in enumerate(words):
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = nxt[v].get(w)
            if to is None:
                continue
            v, size = to, size + 1
            yield i, v, size


class Scanner:
    def __init__(self) -> None:
        self.phrases = [(p.split(), label) for p, label in PHRASES.items()]
        self.templates = [(t.split(), label) for label, t in TEMPLATES]
        sequences = [t for t, _ in self.templates] + [p for p, _ in self.phrases]
        self.sam = SuffixAutomaton(sequences)
        found = {self.sam.state_of(p): (len(p), label) for p, label in self.phrases}
        self.suffix_phrases: list[list[tuple[int, str]]] = [[] for _ in self.sam.length]
        for v in sorted(range(1, len(self.sam.length)), key=lambda v: self.sam.length[v]):
            own = [found[v]] if v in found else []
            self.suffix_phrases[v] = self.suffix_phrases[self.sam.link[v]] + own

    def scan(self, text: str | None) -> dict:
        """Words, base places, labels, score, and spans (label, first word, end word, covered share)."""
        words = WORDS.findall((text or "").translate(LOWER))
        places: list[tuple[int, str]] = []
        long: list[tuple[int, int, int]] = []
        last = (-2, 0, 0)
        for i, v, size in self.sam.matches(words):
            if self.suffix_phrases[v]:
                places += [(i - n + 1, label) for n, label in self.suffix_phrases[v] if n <= size]
            if last[2] >= MIN_MATCH and not (i == last[0] + 1 and size == last[2] + 1):
                long.append(last)
            last = (i, v, size)
        if last[2] >= MIN_MATCH:
            long.append(last)
        spans = [s for s in self._chain(long) if self._tells(s[0], words[s[1] : s[2]])]
        base = {label for _, label in places}
        return {
            "n_words": len(words), "n_base": len(places),
            "first_word": min((s for s, _ in places), default=None), "last_word": max((s for s, _ in places), default=None),
            "base_labels": ",".join(sorted(base)), "labels": ",".join(sorted(base | {s[0] for s in spans if s[3] >= MIN_COVER})),
            "score": 1.0 if places else max((s[3] for s in spans), default=0.0), "spans": spans,
        }

    def _tells(self, label: str, words: list[str]) -> bool:
        """Whether a span has the words that tell its label from others."""
        held = f" {' '.join(words)} "
        return label not in REQUIRED or any(f" {r} " in held for r in REQUIRED[label])

    def _chain(self, long: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """Per template, chains of matches in document and template order; gaps in the document of at most MAX_GAP words."""
        open_: dict[int, list] = {}
        spans: list[tuple[str, int, int, float]] = []

        def close(k: int) -> None:
            first, end, _, covered = open_.pop(k)
            spans.append((self.templates[k][1], first, end, round(covered / len(self.templates[k][0]), 6)))

        for i, v, size in long:
            ends: dict[int, list[int]] = {}
            for k, e in self.sam.ends[v]:
                if k < len(self.templates):
                    ends.setdefault(k, []).append(e)
            for k, at in ends.items():
                chain = open_.get(k)
                if chain and i - size + 1 - chain[1] <= MAX_GAP and any(e > chain[2] for e in at):
                    e = min(e for e in at if e > chain[2])
                    chain[3] += min(size, e - chain[2], i + 1 - chain[1])
                    chain[1:3] = [i + 1, e]
                else:
                    if chain:
                        close(k)
                    open_[k] = [i - size + 1, i + 1, min(at), size]
        for k in list(open_):
            close(k)
        return sorted(spans, key=lambda s: (s[1], s[2], s[0]))


FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,end_word:long,covered:double>>"


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Per row: doc_id and the measures of ``Scanner.scan``."""

    @F.pandas_udf(SCHEMA)
    def scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner()
        for batch in texts:
            rows = [scanner.scan(t) for t in batch]
            out = pd.DataFrame(rows, columns=FIELDS).astype({"first_word": "Int64", "last_word": "Int64"})
            out["spans"] = [[dict(zip(("label", "first_word", "end_word", "covered"), s, strict=True)) for s in r["spans"]] for r in rows]
            yield out

    return docs.select("doc_id", scan("text").alias("found")).select("doc_id", "found.*")
