"""Operator 5, line-first quality rules, in DataFrame functions only.

Each line is judged by punctuation, navigation and boilerplate rules; failing lines are removed and a document
that loses too much of its text is rejected. Every count comes from arrays inside the document's own row: one
narrow stage, no shuffle, so hot sources and groups of copies cost what other rows cost.

Null text: no words, fails the base rule (``n_words`` 0). Empty text: the same. Repeated rows: one result each.
Empty table: empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlab.llm.common import SPACES, let, words_of

SYMBOLS = "#*$%&|<>"
#: Boilerplate phrases (fixed values), matched in lower case.
BOILERPLATE = ["javascript", "cookie policy", "terms of use", "all rights reserved", "privacy policy", "click here", "sign in", "log in"]
NAVIGATION = r"\||>|»|•|::"


def bad_line(line: Column, max_symbols: float = 0.1, max_shout: float = 0.5, min_nav: int = 3) -> Column:
    """True where a line with text fails a rule: symbols, navigation separators, shouting, boilerplate, no letters."""
    size = F.length(line)
    plain = F.length(F.translate(line, SYMBOLS, ""))
    upper = size - F.length(F.regexp_replace(line, r"\p{Lu}", ""))
    lower = size - F.length(F.regexp_replace(line, r"\p{Ll}", ""))
    return (
        (size - plain > max_symbols * size)
        | (F.regexp_count(line, F.lit(NAVIGATION)) >= min_nav)
        | ((upper > lower) & (upper > max_shout * size))
        | (F.lower(line).rlike("|".join(BOILERPLATE)) & (size < 200))
        | ~line.rlike(r"\p{L}")
    )


def repeat_words(words: Column) -> Column:
    """How many words stand in a 3-word window that the document has twice or more.

    Windows become 64-bit hashes; longs of hash and position (as many hash bits as the length leaves) are sorted,
    and neighbours with equal full hashes mark positions. Sorted marks are then unioned: each adds min(3, gap to the next).
    """

    def marks(h: Column) -> Column:
        n = F.greatest(F.size(h), F.lit(1)).cast("long")
        room = F.floor(F.lit(float(1 << 62)) / n)
        packed = F.array_sort(F.transform(h, lambda x, i: F.pmod(x, room) * n + i))
        at = lambda p: (p % n).cast("int")

        def near(p: Column) -> Column:
            no = F.lit(False)
            return F.filter(p, lambda x, i: F.coalesce(x - F.get(p, i - 1) < n, no) | F.coalesce(F.get(p, i + 1) - x < n, no))

        def equal(p: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(h, at(a)) == F.get(h, at(b)), F.lit(False))
            return F.transform(F.filter(p, lambda x, i: same(x, F.get(p, i - 1)) | same(x, F.get(p, i + 1))), at)

        found = let(let(packed, near), lambda p: F.array_sort(equal(p)))
        return F.when(F.size(F.array_distinct(h)) < F.size(h), found).otherwise(F.array().cast("array<int>"))

    def union(m: Column) -> Column:
        steps = F.transform(m, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(m, i + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    hashes = let(
        words,
        lambda w: F.when(
            F.size(w) >= 3,
            F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return let(let(hashes, marks), union)


def base_counts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base measures of the contract."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"))
    lines = let(F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return docs.select(
        "doc_id",
        "text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.cast("long").alias("n_dup_lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
    )


def clean_lines(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The operator: base measures, the text without failing lines, how much was lost, and the verdict.

    ``kept`` is false if the base rule fails or the removed lines hold more than ``max_lost`` of the words' characters.
    """
    out = base_counts(docs)
    full = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    good = let(full, lambda x: F.filter(x, lambda line: ~bad_line(line)))
    out = out.withColumn("clean_text", F.array_join(good, "\n"))
    left = F.length(F.translate("clean_text", SPACES, ""))
    lost = F.when(F.col("word_chars") > 0, 1 - left / F.col("word_chars")).otherwise(0.0)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("*", lost.alias("lost"), failed.alias("base_failed")).withColumn("kept", ~F.col("base_failed") & (F.col("lost") <= max_lost))
