"""A small documents table with everything that operators must bear, and helpers."""

import random

from pyspark.sql import functions as F

WORDS = "the of and a in that is was for it with as his on be at by had not are but from or have an they which one you were".split()


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def texts():
    shared = prose(70, 99)
    base = prose(300, 1)
    near = base.split()
    near[150] = "changed"
    return [
        (0, base), (1, base), (2, " ".join(near)), (3, None), (4, ""), (5, "   \n\t "), (6, "one"), (7, "two words"),
        (8, prose(20, 2) + "\n" + shared + "\n" + prose(20, 3)), (9, prose(30, 4) + "\n" + shared), (10, "é à ü ñ 日本語 😀 " * 40),
        (11, "x" * 5000), (12, prose(30_000, 5)), (13, "a b c d e f g h " * 200), (14, "Line one.\nLine two.\nLine one.\n" * 20),
        (15, "<|endoftext|> in a text <|startoftext|>"), (16, prose(400, 6).upper()), (None, "no id"), (None, None), (17, "Éé'S DON'T can't 1,2;3"),
        (18, "repeated row"), (18, "repeated row"), (18, "same id, other text"), (-5, prose(50, 7)), (1 << 40, base),
    ]


SCHEMA = "doc_id long, text string"


def documents(spark, rows=None):
    """The rows, with extra columns whose names operators use inside."""
    df = spark.createDataFrame(texts() if rows is None else rows, SCHEMA)
    for name in ("start", "length", "ids", "print", "shard", "at", "kind", "score", "bucket", "component", "n_chars", "row", "_row", "segment"):
        df = df.withColumn(name, F.lit(None).cast("string"))
    return df


def empty(spark):
    return documents(spark, [])


def rows(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]
