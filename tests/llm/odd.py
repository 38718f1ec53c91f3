"""Documents with everything that an operator has to take: nulls, empty and long texts, ties, repeats, clashing extra columns."""

CLASHES = ["size", "n", "key", "bucket", "score", "hash", "d", "s", "rows", "cls", "kind", "leaked", "finish", "copy", "start", "target", "w", "node", "a", "b", "comp", "gone", "mix_size", "predicted", "own"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
LONG = "alpha beta gamma delta " * 40_000


def rows():
    base = [
        (1, "the quick brown fox jumps over the lazy dog again and again", "en", "s1"), (2, None, "en", "s1"), (3, "", None, "s2"), (4, " \t\n", "en", None), (5, LONG, "en", "s1"),
        (6, "the quick brown fox jumps over the lazy dog again and again", "en", "s2"), (None, "a text without an id that is fairly long", "en", "s1"), (7, "one two", "en", "s3"), (8, "One TWO", "en", "s3"),
        (9, "same same same same same same same", "en", "s1"), (9, "same same same same same same same", "en", "s1"), (10, "é ☃ \U0001f600 \x00 <|endoftext|> card 4041894974608795", "fr", "s2"), (11, "another text by the same id", "en", "s1"), (11, "a second text by the same id", "en", "s1"),
    ]
    return [(*r, None if r[1] is None else len(r[1]), *(f"x{i}" for i in range(len(CLASHES)))) for r in base]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
