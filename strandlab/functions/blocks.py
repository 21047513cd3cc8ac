"""The aligned strings of an Arrow batch as a matrix, a row per read: what masks, counts and distances are read off."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

GAP, BASES = ord("-"), np.frombuffer(b"ACGT", np.uint8)
#: Bits of the bases a symbol may stand for, by its code.
MASKS = np.zeros(256, np.uint8)
MASKS[np.frombuffer(b"ACMGRSVTWYHKDBN", np.uint8)] = np.arange(1, 16)


def block(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes, cells): code points, a row per string (null: none), and where a row has one; rows end in zeros."""
    strings = strings.cast(pa.string()).fill_null("")
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1] if len(strings) else np.zeros(1, np.int32)
    flat = np.frombuffer(strings.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    size = np.diff(ends)
    if len(flat) and flat.max() > 127:
        each = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in strings.to_pylist()]
        flat, size = np.concatenate(each), np.array([len(s) for s in each])
    cells = np.arange(size.max(initial=0)) < size[:, None]
    codes = np.zeros(cells.shape, flat.dtype)
    codes[cells] = flat
    return codes, cells


def strings(codes: np.ndarray, cells: np.ndarray) -> pa.Array:
    """The strings of each row's cells."""
    ends = np.concatenate([[0], np.cumsum(cells.sum(1))]).astype(np.int32)
    flat = codes[cells]
    if flat.dtype == np.uint8:
        return pa.StringArray.from_buffers(len(cells), pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes()))
    return pa.array([flat[a:b].astype("<u4").tobytes().decode("utf-32-le") for a, b in zip(ends, ends[1:])], pa.string())


def is_base(x: np.ndarray) -> np.ndarray:
    return np.isin(x, BASES)


def homopolymers(x: np.ndarray, min_len: int) -> np.ndarray:
    """Cells in a run of one ACGT base of at least ``min_len``. A run takes in gaps inside and after it, not before it; any
    other symbol ends it."""
    n, width = x.shape
    solid, base = (x != GAP) & (x != 0), is_base(x)
    last, run = np.zeros(n, x.dtype), np.zeros(n, np.int64)
    lasts, runs = np.zeros_like(x), np.zeros((n, width), np.int64)
    for p in range(width):
        run = run + (solid[:, p] & ((x[:, p] != last) | ~base[:, p]))
        last = np.where(solid[:, p], x[:, p], last)
        lasts[:, p], runs[:, p] = last, run
    runs += np.arange(n)[:, None] * (width + 1)
    size = np.bincount(runs[solid], minlength=n * (width + 1))
    return (size[runs] >= min_len) & is_base(lasts)


def repeats(x: np.ndarray, unit: int, times: int, gaps: bool = False) -> np.ndarray:
    """Cells of a motif of ``unit`` ACGT bases that stands ``times`` times on end, gaps left out; ``gaps``: with those inside."""
    need, size, width = unit * (times - 1), unit * times, x.shape[1]
    solid = (x != GAP) & (x != 0)
    hit = np.zeros(x.shape, bool)
    if width < size:
        return hit
    order = np.argsort(~solid, axis=1, kind="stable")
    y = np.where(np.arange(width) < solid.sum(1)[:, None], np.take_along_axis(x, order, 1), 0)
    same = (y[:, unit:] == y[:, :-unit]) & is_base(y[:, unit:])
    upto = np.concatenate([np.zeros((len(x), 1), np.int32), np.cumsum(same, 1, dtype=np.int32)], 1)
    full = upto[:, need:] - upto[:, :-need] == need

    def covered(length: int) -> np.ndarray:
        marks = np.zeros((len(x), width + 1), np.int32)
        marks[:, : full.shape[1]] += full
        marks[:, length : length + full.shape[1]] -= full
        return np.cumsum(marks[:, :width], 1) > 0

    np.put_along_axis(hit, order, covered(size), 1)
    hit &= solid
    if gaps:
        rank = np.cumsum(solid, 1) - 1
        hit |= (x == GAP) & (rank >= 0) & np.take_along_axis(covered(size - 1), np.maximum(rank, 0), 1)
    return hit


def mismatches(a: pa.Array, b: pa.Array, strict: bool) -> pa.Array:
    """Mismatching columns of two aligned strings, by ``a``'s columns: gap pairs match, a gap and a base don't.

    strict: only equal ACGT match; else symbols match if their IUPAC sets meet.
    """
    (x, cells), (y, _) = block(a), block(b)
    if y.shape[1] < x.shape[1]:
        y = np.pad(y, ((0, 0), (0, x.shape[1] - y.shape[1])))
    y = y[:, : x.shape[1]]
    if strict:
        same = (x == y) & is_base(x)
    else:
        bits = lambda v: MASKS[np.where(v < 256, v, 0)]
        same = (bits(x) & bits(y)) > 0
    n = (cells & ~(same | ((x == GAP) & (y == GAP)))).sum(1)
    return pa.array(n, pa.int32(), mask=np.asarray(a.is_null()) | np.asarray(b.is_null()))


def regapped(seq: pa.Array, qual: pa.Array) -> pa.Array:
    """A read's own qualities at the bases of its aligned sequence, '!' at gaps."""
    (x, cells), (q, own) = block(seq), block(qual)
    solid = cells & (x != GAP)
    rank = np.cumsum(solid, 1) - 1
    has = solid & (rank < own.sum(1)[:, None])
    out = np.full(x.shape, ord("!"), q.dtype)
    if q.shape[1]:
        out[has] = np.take_along_axis(q, np.clip(rank, 0, q.shape[1] - 1), 1)[has]
    return strings(out, has | (cells & ~solid))


def picked(text: pa.Array, places: pa.Array) -> pa.Array:
    """Of each string, the characters at ``places``, lists of numbers from 1 that rise."""
    x, cells = block(text)
    keep = np.zeros(x.shape, bool)
    row, at = places.value_parent_indices().to_numpy(), places.flatten().to_numpy() - 1
    inside = at < x.shape[1]
    keep[row[inside], at[inside]] = True
    return strings(x, keep & cells)


def error_sums(qual: pa.Array, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per string of qualities, added up from left to right: the errors 10^(-q/10), the accuracies 100 (1 - error), and the
    number of cells; without those of ``skip``."""
    c, cells = block(qual)
    if skip is not None:
        skip = np.pad(skip, ((0, 0), (0, max(0, c.shape[1] - skip.shape[1]))))[:, : c.shape[1]]
        cells = cells & ~skip
    error = 10.0 ** ((33 - np.arange(128)) / 10)
    errors, sure = np.zeros(len(c)), np.zeros(len(c))
    for p in range(c.shape[1]):
        e = error[np.minimum(c[:, p], 127)]
        errors += np.where(cells[:, p], e, 0.0)
        sure += np.where(cells[:, p], 100 * (1 - e), 0.0)
    return errors, sure, cells.sum(1)
