"""Rows that every operator must take: nulls, empty and long texts, ties, repeats, other columns of any name."""

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, digest string, root long, size long, score double, rank int, line string, row string, copies int"


def documents(spark, *texts, extra=()):
    """(text or (text, source)) with ids from 0, and rows (id, text, lang, source) as given."""
    rows = []
    for k, t in enumerate(texts):
        text, source = t if isinstance(t, tuple) else (t, "s")
        rows.append((k, text, "en", source))
    return spark.createDataFrame([(*r, None, 1, "x", 2, 3, 0.5, 1, "l", "r", 9) for r in [*rows, *extra]], SCHEMA)


ODD = (None, "", " \t\n", "a", "a b c d", "word " * 20000, "x" * 100000, "same text here now ok", "same text here now ok", "é ü 漢字 \U0001f600", "line\n\nline\n")
ODD_ROWS = ((None, "null id text of six words", None, None), (0, "an id again", "en", None), (0, "an id again", "en", None))


def everything(spark):
    return documents(spark, *ODD, extra=ODD_ROWS)
