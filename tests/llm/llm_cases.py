"""Awkward rows every text operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

LONG = " ".join(f"word{i % 997} stands{i % 13}." for i in range(20_000))
BASE = "the quick brown fox jumps over the lazy dog while seven grey geese look on from the far bank of the slow river"
ROWS = [
    (1, BASE, "a", "en"),
    (2, BASE, "a", "en"),
    (3, BASE.upper(), None, "en"),
    (4, None, "b", None),
    (5, "", "b", "en"),
    (6, " \t\n ", "", "en"),
    (7, LONG, "a", "en"),
    (8, LONG + " end", "a", "en"),
    (9, "one", "c", "en"),
    (9, "one", "c", "en"),
    (10, "two words", "c", "fr"),
    (None, "a row without id, but with text", "c", "fr"),
    (11, "naïve café — 日本語 \U0001f600 done. Ünder the sea! it's it", "ß", "fr"),
]
# extra columns named like columns the operators make
SCHEMA = "doc_id bigint, text string, source string, lang string, n_chars bigint, score double, fp bigint, id string, component bigint, bucket int, _size int, key string, x binary"


def awkward(spark):
    rows = [(a, t, s, g, None if t is None else len(t), 0.5, 7, "x", 3, 1, 2, "k", b"") for a, t, s, g in ROWS]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
