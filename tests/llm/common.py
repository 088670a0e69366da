"""Awkward documents: nulls, empty and very long texts, ties, repeated rows, clashing columns."""

import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(30_000))
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word59", "other")
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", None, 1), (3, NEAR, None, "a", 1), (4, None, "en", "a", None), (5, "", "en", "b", 0), (6, "  \t\n ", "en", "b", 3), (7, LONG, "de", "a", 9),
    (8, "Two  words", "de", "c", 9), (9, "two words", "de", "c", 9), (10, "Two words", "de", "c", 9), (11, "é中文 ﬁ \u2003x\u0085y 😀", "fr", "é", 1), (None, "no id at all", "fr", "c", 1), (12, LONG + " end", "de", "a", 9),
    (13, "dup", "en", "a", 3), (13, "dup", "en", "a", 3), (14, "Fresh text!! " * 30, "en", "a", 3),
]


def docs(spark, rows=None, extra=True):
    """The rows above as a table, with columns that clash with the operators' own names."""
    df = spark.createDataFrame(ROWS if rows is None else rows, SCHEMA)
    if extra:
        from pyspark.sql import functions as F

        for name in ("id", "size", "name", "host", "path", "tokens", "rid", "uid", "_id", "verdict", "slot", "block", "kept", "h"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def stored(spark, path, rows=None):
    """The table as Parquet, which the operators may read more than once."""
    docs(spark, rows).write.parquet(str(path))
    return spark.read.parquet(str(path))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())
