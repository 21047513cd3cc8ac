"""Operator 6, benchmark decontamination by a positional inverted index, in DataFrame functions only.

The index stores postings (term, doc_id, pos) of the corpus for the terms the test items use. Each window of a test
item is looked up from its rarest terms: their posting lists, shifted by the term's place in the item, are
intersected on (document, item, diagonal), diagonal = place in the document - place in the item. Surviving
diagonals are then compared word by word with the document, which gives exact phrase matches. Proximity matches are all
pairs of anchors less than a window apart in the item that a document has at diagonals ``slop`` or less apart.

Nothing is sampled or capped. Terms that occur nowhere in the corpus are never anchors; a window with one gives no phrase.

Null texts have no words. Items without words have no windows. Items of fewer than ``size`` words are one window.
Items that share an item_id are matched one by one and count as one; repeated items count once, null item_ids as hits without a name.
Repeated documents, ties and extra columns change nothing; documents sharing a doc_id count as one text each in the
matching but share the id's row (ids are taken to be unique); a null doc_id is never contaminated. Empty tables give empty or clean results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlab.llm.common import ALNUM_GAP, lower_ascii, stage, words_of

WINDOW, ANCHORS, SLOP, MAX_BROADCAST_TERMS = 10, 2, 5, 1_000_000


def tokens(texts: DataFrame, key: str) -> DataFrame:
    """Rows (key, pos, term): term is the word's 64-bit hash, pos counts from 0."""
    return texts.select(key, F.posexplode(words_of(lower_ascii(F.col("text")), ALNUM_GAP)).alias("pos", "word")).select(key, "pos", F.xxhash64("word").alias("term"))


def checked(df: DataFrame, rows: int, limit: int = MAX_BROADCAST_TERMS) -> DataFrame:
    """Broadcast a table of ``rows`` narrow rows if that is at most ``limit``; else leave the join to shuffles."""
    return F.broadcast(df) if rows <= limit else df


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Store postings (term, doc_id, pos) of the corpus for ``terms``, as a Parquet table in the shared folder."""
    return stage(tokens(docs, "doc_id").join(checked(terms, terms.count()), "term"), "postings")


def anchors(items: DataFrame, postings: DataFrame, size: int = WINDOW, rarest: int = ANCHORS) -> DataFrame:
    """Rows (item_id, place, term, need, whole): each window's rarest places, of those whose terms have postings.

    ``whole``: all terms of such a window have postings, so that it can be a phrase; ``need`` is how many places its
    item's diagonals must meet for that.
    """
    counts = postings.groupBy("term").agg(F.count(F.lit(1)).alias("freq"))
    known = items.join(counts, "term", "left").withColumn("freq", F.coalesce("freq", F.lit(0)))
    lengths = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("length"))
    slots = F.explode(F.sequence(F.greatest(F.lit(0), F.col("place") - size + 1), F.least(F.col("place"), F.greatest(F.lit(0), F.col("length") - size))))
    slots = known.join(lengths, "item_id").select("item_id", "place", "term", "freq", "length", slots.alias("window"))
    one = Window.partitionBy("item_id", "window")
    ranked = slots.withColumn("least", F.min("freq").over(one)).where("freq > 0").withColumn("rank", F.row_number().over(one.orderBy("freq", "place")))
    need = F.least(F.lit(rarest), F.col("length")).cast("int")
    return ranked.where(F.col("rank") <= rarest).groupBy("item_id", "place", "term").agg(F.max(need).alias("need"), F.max(F.col("least") > 0).alias("whole"))


def near_pairs(hits: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """(doc_id, item_id, place, place_2, pos, pos_2): anchors at two places of an item, place < place_2, less than ``size``
    apart, whose document positions pos and pos_2 are ``slop`` or less nearer or farther apart than the places.

    Both sides meet in cells of places and diagonals, so that work follows the pairs near each other, not all of a document.
    """
    cell = lambda c, width: F.floor(F.col(c) / width)
    x = hits.select("doc_id", "item_id", "place", "pos", "diagonal", cell("place", size).alias("pc"), cell("diagonal", slop + 1).alias("dc"))
    y = hits.select("doc_id", "item_id", F.col("place").alias("place_2"), F.col("pos").alias("pos_2"), F.col("diagonal").alias("diagonal_2"), F.explode(F.array(*(F.struct((cell("place", size) + i).alias("pc"), (cell("diagonal", slop + 1) + j).alias("dc")) for i in (-1, 0) for j in (-1, 0, 1)))).alias("at"))
    y = y.select("doc_id", "item_id", "place_2", "pos_2", "diagonal_2", "at.pc", "at.dc")
    near = (F.col("place_2") - F.col("place")).between(1, size - 1) & (F.abs(F.col("diagonal_2") - F.col("diagonal")) <= slop) & (F.col("pos") != F.col("pos_2"))
    return x.join(y, ["doc_id", "item_id", "pc", "dc"]).where(near).select("doc_id", "item_id", "place", "place_2", "pos", "pos_2")


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> tuple[DataFrame, DataFrame]:
    """(phrase, proximity) matches.

    phrase: (doc_id, item_id, start, length), a maximal run of document words inside occurrences of item windows.
    proximity: the rows of ``near_pairs``.
    """
    items = stage(tokens(benchmark, "item_id").withColumnRenamed("pos", "place"), "item-terms")
    n_items = items.count()
    postings = build_index(docs, items.select("term").distinct())
    keys = stage(anchors(items, postings, size), "anchors")
    hits = postings.join(checked(keys, keys.count()), "term").select("doc_id", "item_id", "place", "pos", "need", "whole", (F.col("pos") - F.col("place")).alias("diagonal"))
    met = hits.where("whole").groupBy("doc_id", "item_id", "diagonal").agg(F.count(F.lit(1)).alias("met"), F.max("need").alias("need"), F.min("place").alias("low"), F.max("place").alias("high")).where("met >= need")
    met = stage(met.select("doc_id", "item_id", "diagonal", (F.col("low") - size + 1).alias("low"), (F.col("high") + size - 1).alias("high")), "diagonals")
    found = docs.join(met.select("doc_id").distinct(), "doc_id", "left_semi")
    words = tokens(found, "doc_id")
    lengths = items.groupBy("item_id").agg(F.count(F.lit(1)).alias("length"))
    lined = met.join(checked(lengths, n_items), "item_id").withColumn("place", F.explode(F.sequence(F.greatest(F.col("low"), F.lit(0), -F.col("diagonal")), F.greatest(F.least(F.col("high"), F.col("length") - 1).cast("int"), F.greatest(F.col("low"), F.lit(0), -F.col("diagonal"))))))
    lined = lined.join(checked(items, n_items), ["item_id", "place"]).select("doc_id", (F.col("diagonal") + F.col("place")).alias("pos"), "term", "item_id", "diagonal", "place", "length")
    same = lined.join(words, ["doc_id", "pos", "term"]).distinct()
    line = Window.partitionBy("doc_id", "item_id", "diagonal").orderBy("place")
    runs = same.withColumn("run", F.col("place") - F.row_number().over(line)).groupBy("doc_id", "item_id", "diagonal", "run").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("n"), F.max("length").alias("length"))
    phrase = runs.where(F.col("n") >= F.least(F.lit(size), F.col("length"))).select("doc_id", "item_id", "start", F.col("n").alias("length"))
    return stage(phrase, "phrases"), near_pairs(hits, size, slop)


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted as strings), n_near and contaminated."""
    docs = docs.select("doc_id", "text")
    items = benchmark.select(F.struct("item_id", F.xxhash64("text").alias("text")).alias("item_id"), "text").dropDuplicates(["item_id"])
    phrase, near = find(docs, items, size, slop)
    before = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("doc_id").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), F.col("start") + F.col("length") - F.greatest(F.col("start"), F.coalesce(before, F.lit(0))))
    hit = phrase.withColumn("fresh", fresh).groupBy("doc_id").agg(F.sum("fresh").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id.item_id").cast("string"))).alias("items"))
    close = near.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_near"))
    n_words = F.size(words_of(lower_ascii(F.col("text")), ALNUM_GAP)).cast("long")
    out = docs.select("doc_id", n_words.alias("n_words")).join(hit, "doc_id", "left").join(close, "doc_id", "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), items.alias("items"), F.size(items).cast("long").alias("n_items"), F.coalesce("n_near", F.lit(0)).alias("n_near"), (n_hit > 0).alias("contaminated"))
