"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, clashing names."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, shard int, key long, fp long, n long, task long"

LONG = " ".join(f"word{i % 977} and more" for i in range(30_000)) + " " + "x" * 50_000
TEXTS = ["", None, " \t\n\x0b\f\r ", "one", "one two", "One two THREE", "one two three four", "a b   c", "é è ç 漢字 😀 é", "x" * 5000, "<|endoftext|> a<|startoftext|>b it's don't 12 34", LONG]


def awkward(spark):
    rows = [(i, t, "en" if i % 3 else None, "s" if i % 2 else None, 1, 0.5, 1, 1, 1, 1, 1, 1) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", None, None, None, None, None, None, None, None, None, None)] * 2 + [(None, "one", "de", "t", 1, 0.1, 1, 1, 1, 1, 1, 1), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


#: Names that stages may use for columns of their own on the way.
CLASHES = ("id", "_id", "of", "keep", "copies", "key", "row", "verdict", "kept", "n_words", "clean_text", "_text", "_hashes", "_lines", "lines", "hashes", "words", "source_size", "_source", "_size", "size", "_times", "times", "_copy", "col", "last", "epochs", "own", "_cands", "cands", "_spans", "spans", "put", "root", "node", "_of", "_keep", "best", "first", "text_", "h", "part")


def clashing(spark):
    """A few plain documents, each with a value of its own in a column of every such name."""
    text = "It was a bright cold day in April, and the clocks were striking thirteen. Some words are number {i} of the rest, as all of them are in such a text of words.\n Mail a{i}@b.co for more of it."
    rows = [(i, text.format(i=i) if i % 2 else text.format(i=i) + f" And it ends {i} with a sentence of its own kind.", "en", f"s{i % 3}", 1, *(f"{c}{i}" for c in CLASHES)) for i in range(12)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))
