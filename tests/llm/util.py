"""Small tables that hold every awkward case."""

import random

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=None):
    """Rows numbered from 0; extra adds columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for c in extra or ():
        from pyspark.sql import functions as F

        df = df.withColumn(c, F.lit("clash"))
    return df


def prose(rnd, n, words=400):
    return " ".join(f"w{rnd.randrange(words)}" for _ in range(n))


def edited(rnd, text, n):
    ws = text.split(" ")
    for _ in range(n):
        ws[rnd.randrange(len(ws))] = f"e{rnd.randrange(10**6)}"
    return " ".join(ws)


def rng(seed=1):
    return random.Random(seed)
