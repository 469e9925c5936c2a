"""Rows that operators must stand: nulls, empty and long texts, repeats, and extra columns whose names clash with the operators' own."""

from pyspark.sql import functions as F

CLASHING = ["id", "id0", "k1", "node", "n", "band", "label", "size", "part", "row", "key", "start", "target", "taken", "bits", "name", "first", "score", "lang_pred", "pieces", "kept", "spans", "_lines", "_words", "__text", "lost"]
LONG = " ".join(f"long{i % 977} words, here" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today, again and again.", "en", "web", 10),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today, again and again.", "en", "web", 10),
    (2, None, "en", "web", None),
    (3, "", None, None, 0),
    (4, " \t\n\x0b ", "de", "web", 5),
    (5, "12345 67890 !!!", None, "code", 5),
    (None, "Un texte sans nom, qui reste ici avec quelques mots de plus pour voir.", "fr", "web", 5),
    (6, LONG, "en", "hot", None),
    (7, "The quick brown fox jumps over the lazy dog near the river bank today, again and again.", None, None, 1),
    (8, "mail me@example.org or call +49 30 1234567 from 10.0.0.1, card 4111 1111 1111 1111", "en", "web", 1),
    (9, "é中\U0001f600 ß", "zz", "web", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(i) for i, c in enumerate(CLASHING)})


def none(spark):
    return odd(spark).limit(0)
