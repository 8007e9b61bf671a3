"""Documents with what real corpora hold: nulls, empty texts, ties, repeated rows, long texts."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long, text_len int"


def edge_documents(spark):
    """No row is plain: null ids, texts and sources, equal ids, equal rows, a long text, an extra column."""
    long = " ".join(f"word{i % 977} filler{i % 13}" for i in range(30_000))
    rows = [
        (3, "one two three four five six", "en", "a", 27, 1),
        (3, "one two three four five six", "en", "a", 27, 1),
        (3, "another text under the same id", "en", "b", 30, 2),
        (None, "no id here", "en", "a", 10, 3),
        (None, None, None, None, None, None),
        (1, None, "en", "a", None, 4),
        (2, "", "en", "a", 0, 5),
        (7, "   \n\n \t", "en", None, 7, 6),
        (8, long, "en", "a", len(long), 7),
        (9, long, "en", "b", len(long), 8),
        (10, "été 漢字 🙂 x", "fr", "c", 10, 9),
    ]
    return spark.createDataFrame(rows, DOCS)


def empty_documents(spark):
    return spark.createDataFrame([], DOCS)
