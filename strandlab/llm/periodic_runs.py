"""Operator 11, periodic runs: stretches of words that repeat with a period, found with a suffix automaton.

Each state of the automaton of a word sequence stands for words with the same end positions, its longest word being
``length`` words long. End positions are merged along suffix links, longest states first, the smaller ordered set into the
larger. When an element is put between its neighbours, a distance of at most the state's length means that the longest word
occurs twice at that distance, overlapping or touching: a square. It can't be moved further left, since the two positions
meet at their longest common suffix, so it only has to be extended to the right to give a run. In a run of smallest period
q, its end and the position q before are neighbours at the state where they meet, so no run is missed.

A run of at least ``min_words`` words that holds its period ``times`` times over repeats ``min_words - min_words // times``
words in a row at one distance, and all its words lie in such repeats. So only stretches of a text that consist of word
n-grams of that size which occur again in it are given to the automaton; they contain every run whole, and the words beside them
extend none. The n-grams are found by hashes computed over the batch's bytes at once; an accidental match only widens a stretch.
For the same reason end positions need no merging in states whose words are shorter than that.

One narrow pass, no shuffle. Memory of a task: some 40 bytes for each byte of a 2 MB slice, or of the longest text, and about
1 KB for each word of the longest repetitive stretch. Words are compared as they are, in UTF-8 bytes.

Null text: no words. Rows that share an id are each searched. Ties between runs: all are reported. Empty table: no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from strandlab.llm.common import in_slices

MIN_WORDS, TIMES = 24, 3
#: Odd multipliers of the hashes, and the inverse of the first modulo 2^64.
BASE, STEP, OWNER = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1024


class Ends:
    """An ordered set of end positions in chunks, so that an insertion moves few elements."""

    __slots__ = ("chunks", "lows", "size")

    def __init__(self, x: int) -> None:
        self.chunks, self.lows, self.size = [[x]], [x], 1

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Put ``x`` in; its neighbours."""
        k = max(0, bisect_right(self.lows, x) - 1)
        chunk = self.chunks[k]
        at = bisect_left(chunk, x)
        before = chunk[at - 1] if at else self.chunks[k - 1][-1] if k else None
        after = chunk[at] if at < len(chunk) else self.chunks[k + 1][0] if k + 1 < len(self.chunks) else None
        chunk.insert(at, x)
        self.lows[k] = chunk[0]
        self.size += 1
        if len(chunk) > CHUNK:
            self.chunks[k : k + 1] = [chunk[: CHUNK // 2], chunk[CHUNK // 2 :]]
            self.lows[k : k + 1] = [chunk[0], chunk[CHUNK // 2]]
        return before, after


def automaton(words: list) -> tuple[list[int], list[int], list[int]]:
    """Per state of the suffix automaton: suffix link, length, and end position (-1 for the root and clones)."""
    steps: list[dict] = [{}]
    link, length, end, last = [-1], [0], [-1], 0
    for i, w in enumerate(words):
        new, p = len(steps), last
        steps.append({})
        link.append(0)
        length.append(i + 1)
        end.append(i)
        while p >= 0 and w not in steps[p]:
            steps[p][w] = new
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(steps)
                steps.append(steps[q].copy())
                link.append(link[q])
                length.append(length[p] + 1)
                end.append(-1)
                link[q] = link[new] = clone
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = clone
                    p = link[p]
        last = new
    return link, length, end


def seeds(words: list, least: int) -> set[tuple[int, int, int]]:
    """Squares (start, end, period): stretches of two periods or more that can't be moved left, the repeat ``least`` words or longer."""
    link, length, end = automaton(words)
    sets: list[Ends | None] = [Ends(x) if x >= 0 and n >= least else None for x, n in zip(end, length, strict=True)]
    found = set()
    for v in sorted((v for v in range(1, len(link)) if length[v] >= least), key=length.__getitem__, reverse=True):
        up, own = link[v], sets[v]
        n = length[up]
        if n < least or own is None:
            sets[v] = None
            continue
        into, sets[v] = sets[up], None
        if into is None:
            sets[up] = own
            continue
        if into.size < own.size:
            into, own = own, into
        last = None
        for chunk in own.chunks:
            for x in chunk:
                before, after = into.insert(x)
                if before is not None and before != last and x - before <= n:  # else both come from one state, and meet in a longer one
                    found.add((before - n + 1, x, x - before))
                last = x
                if after is not None and after - x <= n:
                    found.add((x - n + 1, after, after - x))
        sets[up] = into
    return found


def runs_of(words: list, min_words: int = MIN_WORDS, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of ``words``, by start, then period."""
    stretches: dict[tuple[int, int], int] = {}
    done: dict[tuple[int, int], int] = {}
    for start, last, q in sorted(seeds(words, min_words - min_words // times)):
        if last <= done.get((start, q), -1):
            continue
        last += 1
        while last < len(words) and words[last] == words[last - q]:
            last += 1
        done[start, q] = last - 1
        stretches[start, last] = min(q, stretches.get((start, last), q))
    return sorted((s, e - s, q) for (s, e), q in stretches.items() if e - s >= max(min_words, times * q))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """``words`` without those that some run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, n, q in runs:
        change[start + q] += 1
        change[start + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word in the rows' bytes."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def repeated_stretches(data: np.ndarray, offsets: np.ndarray, n: int) -> dict[int, list[tuple[int, int]]]:
    """Per row, the stretches (first word, end word) made of n-grams of words whose hash occurs again in the row."""
    starts, ends, row = word_spans(data, offsets)
    if len(starts) < n:
        return {}
    with np.errstate(over="ignore"):
        powers = np.full(len(data) + 1, np.uint64(BASE))
        powers[0] = 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * np.cumprod(powers)[:-1], out=sums[1:])
        powers[1:] = np.uint64(INVERSE)
        word = (sums[ends] - sums[starts]) * np.cumprod(powers)[starts]
        word ^= word >> np.uint64(29)
        word *= np.uint64(STEP)
        word ^= word >> np.uint64(32)
        grams = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            grams = grams * np.uint64(STEP) + word[k : len(word) - n + 1 + k]
        grams += row[: len(grams)].astype(np.uint64) * np.uint64(OWNER)
    whole = np.flatnonzero(row[: len(grams)] == row[n - 1 :])
    order = whole[np.argsort(grams[whole])]
    same = grams[order[1:]] == grams[order[:-1]]
    change = np.zeros(len(word) + 1, np.int64)
    again = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    change[again] += 1
    change[again + n] -= 1
    held = np.cumsum(change[:-1]) > 0
    first = held.copy()
    first[1:] &= ~held[:-1] | (row[1:] != row[:-1])
    last = held.copy()
    last[:-1] &= ~held[1:] | (row[1:] != row[:-1])
    base = np.searchsorted(row, np.arange(len(offsets) - 1))
    out: dict[int, list[tuple[int, int]]] = {}
    for a, b in zip(np.flatnonzero(first).tolist(), (np.flatnonzero(last) + 1).tolist(), strict=True):
        r = int(row[a])
        out.setdefault(r, []).append((a - int(base[r]), b - int(base[r])))
    return out


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, times: int = TIMES) -> DataFrame:
    """Per row: doc_id, n_words, runs (start, length, period; by start, then period) and collapsed, the words left, joined by blanks.

    A run is a stretch of consecutive words of smallest period q, at least ``min_words`` and ``times * q`` words long,
    that no neighbouring word extends. ``times`` is at least 2.
    """
    if times < 2 or min_words < times:
        raise ValueError("times must be at least 2, min_words at least times")
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in in_slices(batch):
                texts = [(t or "").encode() for t in part.column("text").to_pylist()]
                offsets = np.cumsum([0, *map(len, texts)])
                stretches = repeated_stretches(np.frombuffer(b"".join(texts), np.uint8), offsets, min_words - min_words // times)
                counts, runs, left = [], [], []
                for k, text in enumerate(texts):
                    words = text.split()
                    own = [(a + s, n, q) for a, b in stretches.get(k, ()) for s, n, q in runs_of(words[a:b], min_words, times)]
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": q} for s, n, q in own])
                    left.append(b" ".join(collapse(words, own) if own else words).decode())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(runs, pa.list_(run)), pa.array(left, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(search, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
