"""Operator 13, best-fit packing: token pieces into as few sequences of a fixed length as best fit decreasing finds.

The plan is made over a histogram of lengths, not over documents: best fit decreasing handles all pieces of one length at
once, and bins that hold the same lengths stay one range of numbers, of which a length splits at most one. The histogram has
at most ``capacity`` rows and the plan at most some hundred thousand, whatever the corpus, so both may pass the driver.
Pieces then take the planned slots by a join on their rank within their length.

Ranks need no shuffle by length, which a common length would make hot: the tokenising tasks number their own pieces of each
length, and running sums of the counts per (task, length) turn these into ranks. The tokenised table is written to the
shared folder first, so numbers stay as they are when executors are lost. Slots are unrolled in chunks, in Spark.

Tokens: the ids that ``tokenizers`` gives with byte_bpe_50k.json. They are made with the same vocabulary's ranks, which takes a
fifth of the time; tests hold them against ``tokenizers``.

Null text: empty, so only the end token. Rows that share an id, or have none, are packed each for itself. Empty table: no
rows. Other columns are not read. Texts longer than a sequence are cut; their first piece may be shorter, the others are full.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import in_slices, stage

CAPACITY, END_ID, VOCABULARY = 2048, 0, "byte_bpe_50k.tiktoken"
SLOTS_PER_ROW = 1 << 16


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, by a file of ranks; strings of special tokens are ordinary text."""

    def __init__(self, ranks: str) -> None:
        import public_tokenizers
        import tiktoken

        with open(ranks if os.path.isabs(ranks) else public_tokenizers.path(ranks), "rb") as f:
            words = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=words, special_tokens={})

    def encode(self, text: str) -> bytes:
        return np.array(self.coder.encode_ordinary(text), "<u4").tobytes()


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, task, place[, ids]), written to the shared folder.

    ``place`` numbers the pieces of one length within a task. ``ids`` holds little-endian 32-bit ids.
    """
    end = np.array([end_id], "<u4").tobytes()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = pyspark.TaskContext.get().partitionId()
        encoder, seen = Encoder(vocabulary), [0] * (capacity + 1)
        for batch in batches:
            for part in in_slices(batch):
                rows = []
                for k, text in enumerate(part.column("text").to_pylist()):
                    ids = encoder.encode(text or "") + end
                    for j, (start, n) in enumerate(cut(len(ids) // 4, capacity)):
                        held = ids[4 * start : 4 * (start + n)]
                        rows.append((k, j, start, n, zlib.crc32(held), seen[n], held))
                        seen[n] += 1
                at, piece, start, n, crc, place, held = zip(*rows, strict=True)
                columns = [part.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, n, crc)), pa.array([task] * len(rows), pa.int32()), pa.array(place, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(held, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, place long" + ", ids binary" * keep_ids
    return stage(docs.select("doc_id", "text").mapInArrow(pieces, schema), "token-pieces")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing over a histogram: rows (length, rank, per_bin, bin, n_bins, offset).

    The pieces of ``length`` with ranks from ``rank`` fill the bins from ``bin`` on, ``per_bin`` in each, from ``offset``.
    """
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first bin, bins)
    rows, bins = [], 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        for room in [*range(length, capacity), capacity]:
            while left and (rooms[room] or room == capacity):
                each = room // length
                if rooms[room]:
                    first, n = rooms[room].pop()
                else:
                    first, n = bins, -(-left // each)
                    bins += n
                whole = min(n, left // each)
                if whole:
                    rows.append((length, rank, each, first, whole, capacity - room))
                    rooms[room - each * length].append((first, whole))
                    rank, left = rank + whole * each, left - whole * each
                    first, n = first + whole, n - whole
                if n and left:
                    rows.append((length, rank, left, first, 1, capacity - room))
                    rooms[room - left * length].append((first, 1))
                    rank, left = rank + left, 0
                    first, n = first + 1, n - 1
                if n:
                    rooms[room].append((first, n))
    return rows


def ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, their number within their length over all tasks."""
    counts = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return pieces.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place")).drop("base", "task", "place")


def slots(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Rows (length, rank, sequence_id, offset): the planned slot of every piece. At most ``capacity`` counts pass the driver."""
    spark = pieces.sparkSession
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    names = ["length", "first", "per_bin", "bin", "n_bins", "base"]
    rows = spark.createDataFrame(pd.DataFrame(plan(counts, capacity), columns=names, dtype="int64"), ", ".join(f"{c} long" for c in names))
    total = F.col("n_bins") * F.col("per_bin")
    rows = rows.select("*", total.alias("total"), F.explode(F.sequence(F.lit(0).cast("long"), total - 1, F.lit(SLOTS_PER_ROW).cast("long"))).alias("chunk"))
    # by number: rows so narrow would all run in one task, though each stands for many slots
    rows = rows.repartition(max(1, min(sum(counts.values()) // SLOTS_PER_ROW + 1, 1 << 15)))
    rows = rows.select("*", F.explode(F.sequence("chunk", F.least(F.col("chunk") + SLOTS_PER_ROW, F.col("total")) - 1)).alias("j"))
    return rows.select("length", (F.col("first") + F.col("j")).alias("rank"), F.expr("bin + j div per_bin").alias("sequence_id"), (F.col("base") + F.col("j") % F.col("per_bin") * F.col("length")).alias("offset"))


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY, keep_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its ids where ``keep_ids``."""
    pieces = token_pieces(docs, capacity, end_id, vocabulary, keep_ids)
    # the plan's size doesn't tell how many slots it makes, so Spark mustn't take them for a small table
    out = ranked(pieces).join(slots(pieces, capacity).hint("merge"), ["length", "rank"])
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["ids"] * keep_ids)


def sequences(packed: DataFrame) -> DataFrame:
    """Per sequence: sequence_id, n_tokens, n_pieces, ids (little-endian 32-bit). ``packed`` needs its ids; a sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined: Column = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.count(F.lit(1)).alias("n_pieces"), joined.alias("ids"))
