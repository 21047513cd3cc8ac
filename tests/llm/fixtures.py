"""Small awkward tables shared by the tests."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, size long"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew potions near the old stone bridge at dawn"


def rows():
    long = " ".join(f"word{k % 977} tail{k % 31}" for k in range(30_000))
    near = PROSE.replace("seven", "eight")
    base = [
        (0, PROSE + ".\n" + PROSE.upper(), "en", "a"),
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n\n  ", "en", "b"),
        (4, PROSE, "en", "a"),
        (5, PROSE, None, None),
        (6, near, "en", "b"),
        (7, long, "fr", "a"),
        (8, long + " end", "fr", "a"),
        (9, "Under the MIT License. CC BY-NC 4.0; apache license version 2", "en", "c"),
        (10, "one", "de", "c"),
        (11, "####\n| a | b | c | d |\n" + "ha " * 60, "de", "c"),
        (12, "é ü 漢字 𝒳 \x0b\x0c x", "fr", ""),
    ]
    return [(i, t, lang, s, len(t or ""), "clash", -1) for i, t, lang, s in base]


def docs(spark, extra=()):
    return spark.createDataFrame([*rows(), *extra], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
