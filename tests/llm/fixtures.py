"""Small tables with every odd case: nulls, empty and long texts, repeats, extra and clashing columns."""

import random

from pyspark.sql import Row
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i:03d}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(spark, seed=1):
    """Documents with copies, near copies, shared passages and odd rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 160)) for _ in range(60)]
    shared = prose(rng, 70)
    texts += [prose(rng, 30) + " " + shared + "\n" + prose(rng, 20) for _ in range(6)]
    texts += [texts[3]] * 5
    long = prose(rng, 400)
    for i in range(6):
        w = long.split()
        w[7 * i] = "edited"
        texts.append(" ".join(w))
    texts += ["", " \n\t ", "x", "x" * 30_000, "y z " * 6_000, "Ünïcödé É ß 漢字 🙂 " * 40]
    rows = [Row(doc_id=i * 3 % 101 + i, text=t, lang=rng.choice(["en", "de", None]), source=rng.choice(["a", "b", None]), n_chars=len(t)) for i, t in enumerate(texts)]
    rows += [Row(doc_id=None, text="no id here", lang="en", source="a", n_chars=1), Row(doc_id=None, text=None, lang=None, source=None, n_chars=None), Row(doc_id=900, text=None, lang="en", source="a", n_chars=0)]
    rows += [rows[5], rows[5], rows[0]]
    return spark.createDataFrame(rows, DOCS)


def widened(df):
    """The same rows with more columns, some of which bear names the operators use inside."""
    for c in ("score", "shard", "slot", "copies", "_key", "_a", "accepted", "position"):
        df = df.withColumn(c, F.lit(f"own {c}"))
    return df


def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
