"""Counts over the cells of aligned reads, without a row per cell: a batch of reads gives one row per group and column.

Only such partial counts are shuffled, so that a large sample's alignment never is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlab.functions import blocks

#: A matrix of truth values from the codes and the qualities of a batch of reads.
Mark = Callable[[np.ndarray, np.ndarray], np.ndarray]


def is_symbol(symbol: str) -> Mark:
    return lambda x, q: x == ord(symbol)


def tally(reads: DataFrame, keys: list[str], marks: dict[str, Mark]) -> DataFrame:
    """(keys ..., pos, <mark> ..., n_all): per group of reads (aln_seq, aln_qual) and column, the cells that each mark holds of, and all."""
    names, kinds = [*marks, "n_all"], {k: reads.schema[k].dataType.simpleString() for k in keys}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cells = blocks.block(batch.column("aln_seq"))
            if not cells.any():
                continue
            q = blocks.block(batch.column("aln_qual"))[0].astype(np.int16) - 33
            q = np.pad(q, ((0, 0), (0, max(0, x.shape[1] - q.shape[1]))), constant_values=-33)[:, : x.shape[1]]
            groups = batch.select(keys).to_pandas().groupby(keys, dropna=False, sort=False)
            group = groups.ngroup().to_numpy()
            order = np.argsort(group, kind="stable")
            starts = np.concatenate([[0], np.flatnonzero(np.diff(group[order])) + 1])
            sums = [np.add.reduceat(m[order], starts, axis=0, dtype=np.int64) for m in (*((f(x, q) & cells) for f in marks.values()), cells)]
            row, pos = np.nonzero(sums[-1])
            first = batch.select(keys).take(pa.array(order[starts][row]))
            yield pa.RecordBatch.from_arrays([*first.columns, pa.array(pos + 1, pa.int32()), *(pa.array(s[row, pos]) for s in sums)], names=[*keys, "pos", *names])

    schema = ", ".join([*(f"{k} {t}" for k, t in kinds.items()), "pos int", *(f"{n} long" for n in names)])
    return reads.select(*keys, "aln_seq", "aln_qual").mapInArrow(count, schema).groupBy(*keys, "pos").agg(*(F.sum(n).alias(n) for n in names))


def cells_at(reads: DataFrame, places: DataFrame, key: str = "sample_id") -> DataFrame:
    """``reads`` with a row for each of their sample's ``places`` (key, pos) instead of a row per cell: pos, base, q in place of
    aln_seq and aln_qual. Reads meet lists of places, so that where these are few nothing is shuffled."""
    at = places.groupBy(key).agg(F.collect_set("pos").alias("at"))
    rest = [c for c in reads.columns if c not in ("aln_seq", "aln_qual")]
    rows = reads.join(at, key).select(*rest, "aln_seq", "aln_qual", F.explode("at").alias("pos"))
    base = F.substr("aln_seq", F.col("pos"), F.lit(1))
    return rows.select(*rest, "pos", base.alias("base"), (F.ascii(F.substr("aln_qual", F.col("pos"), F.lit(1))) - 33).alias("q")).where("base != ''")
