"""Small tables with everything that a column may hold."""

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, content long, score double, "
          "fp string, label int, _text string, size string, copies int")


def odd_docs(spark, texts=()):
    """Null ids and texts, empty and blank texts, repeated rows, and columns with names that
    operators use themselves."""
    rows = [(1, "one two three four five six"), (2, "One  two\tthree four five six"), (3, None), (4, ""),
            (5, " \n\t"), (None, "a text without an id"), (None, None), (7, "repeated row"), (7, "repeated row"),
            (7, "another text of the same id"), (8, "é ü ß Ünïcode 😀 <|endoftext|> don't"), (9, "x")]
    rows += [(100 + n, t) for n, t in enumerate(texts)]
    return spark.createDataFrame(
        [(i, t, "en" if i and i % 2 else None, None if i == 4 else f"s{(i or 0) % 3}", None, 5, 0.5, "f", 7, "q", "z", 3)
         for i, t in rows], SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
