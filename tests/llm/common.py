"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, n_tokens string, leaks string, lang_pred string, predicted string, sequence_id string"
CLASH = ("x",) * 7


def odd_rows():
    words = "the quick brown fox jumps over the lazy dog and runs far away from here today".split()
    base = " ".join(words)
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base, None, None, None), (3, None, "en", "a", None), (4, "", "en", None, 0), (5, "   \n\t ", None, "a", 6),
        (None, base, "en", "a", 5), (None, None, None, None, None), (6, "word " * 40_000, "en", "a", 200_000), (7, "x" * 100_000, None, "b", 100_000),
        (8, "Ünïcödé ΑΒΓ 你好 🙂 <|endoftext|> \u0000 end", "de", "b", 9), (9, "two words", "en", "a", 9), (10, "Two  words", "en", "a", 10), (11, "12345 !!!", "en", "a", 9),
    ]
    return [r + CLASH for r in rows]


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
