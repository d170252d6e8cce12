"""Small frames with the awkward cases that every operator must take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, extra=""):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(r.randint(2, 9))) for _ in range(vocabulary)]
    r = random.Random(seed * 7919 + n)
    return " ".join(r.choice(words) for _ in range(n))
