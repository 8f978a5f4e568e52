"""Edge rows for the operators over documents."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = SCHEMA + ", id string, spans int, h int, fp string, keep string, weight double"


def rows():
    long_text = "lorem ipsum dolor sit amet consectetur " * 4000
    return [
        (1, None, "en", "s", None), (2, "", None, None, 0), (3, " \n\t ", "en", "s", 4),
        (4, "one", "en", "s", 3), (5, "a tie of words here", "en", "s", 19), (6, "a tie of words here", "de", "t", 19),
        (7, long_text, "en", "s", len(long_text)), (7, long_text, "en", "s", len(long_text)),
        (None, "a row without an id", "en", "s", 19), (None, "a row without an id", "en", "s", 19),
        (9, "Größe naïve 中文 \U0001F600 emoji", "de", "s", 24), (10, "a\x00b c", "en", None, 5),
    ]


def docs(spark, extra=False):
    if extra:
        return spark.createDataFrame([r + ("x", 1, 2, "fp", "yes", 0.5) for r in rows()], EXTRA)
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
