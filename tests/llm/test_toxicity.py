import random
import zlib

import numpy as np
import zstandard
from pyspark.sql import functions as F

from coppice.llm import toxicity as tx
from tests.llm.fixtures import DOCS, SF, frame, prose

BAD = ["worthless", "pathetic", "disgusting", "scumbag"]


USUAL = prose(1, 400).split(" ")


def corpus(n, seed):
    r = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        words = r.choices(USUAL, k=r.randint(30, 120))
        toxic = i % 3 == 0
        for _ in range(4 if toxic else 0):
            words[r.randrange(len(words))] = r.choice(BAD)
        texts.append(" ".join(words))
        labels.append(int(toxic))
    return texts, labels


def test_windows_cover_the_text():
    for t in ("", "a", "é" * 500, "日" * 5000, "word " * 400, "two words\n" * 5000, prose(3, 500), " lead and  double ", "x" * 64, "y" * 65):
        parts = tx.windows(t)
        assert b"".join(parts) == t.encode().lower() and all(len(p) <= 2 * tx.WINDOW and p.decode() for p in parts)
    assert tx.windows(None) == [] and len(tx.windows("two words\n" * 5000)) > 500


def test_savings_are_those_of_plain_compression():
    model = tx.fit(*corpus(400, 4))
    texts, _ = corpus(5, 9)
    how = zstandard.ZstdCompressionParameters(window_log=20, hash_log=tx.HASH, chain_log=tx.CHAIN, search_log=tx.SEARCH, min_match=tx.MATCH, strategy=tx.STRATEGY, write_content_size=0, write_dict_id=0, write_checksum=0)

    def plain(sizes, part):
        d = zstandard.ZstdCompressionDict(sizes.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        return len(zstandard.ZstdCompressor(dict_data=d, compression_params=how).compress(part))

    assert len(model.toxic) == 2
    for t in texts:
        parts = tx.windows(t)
        want = [min(plain(model.ordinary, p) - plain(d, p) for d in model.toxic) for p in parts]
        assert model.savings(parts).tolist() == want
        x = (tx.features(np.array(want)) - model.mean) / model.scale
        assert abs(model.scores([t])[0] - 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))) < 1e-12


def test_relabelled_windows_hold_what_tells_toxic_texts():
    texts, labels = corpus(900, 6)
    usual = [t for t, y in zip(texts, labels) if not y]
    ordinary = tx.Sizes(tx._dictionary([p for t in usual for p in tx.windows(t)], tx.ORDINARY))
    bad = [t for t, y in zip(texts, labels) if y]
    chosen = tx.relabelled(bad, [p for t in usual[:200] for p in tx.windows(t)], ordinary)
    share = lambda parts: sum(any(w.encode() in p for w in BAD) for p in parts) / len(parts)
    assert min(map(share, chosen)) > 0.9 > share([p for t in bad for p in tx.windows(t)])


def test_separates_held_out_texts():
    model = tx.fit(*corpus(900, 1))
    texts, labels = corpus(300, 2)
    s = model.scores(texts)
    assert ((s >= tx.THRESHOLD) == labels).mean() > 0.95
    odd = model.scores([None, "", "x", "word " * 20000])
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1]


def test_without_two_classes():
    assert tx.fit([], []).scores(["a", None]).max() < 1e-3
    assert tx.fit(["a", "b"], [1, 1]).scores(["z"])[0] > 0.99
    few = tx.fit(["a b", "c d"], [1, 0]).scores(["a b"])
    assert 0 <= few[0] <= 1


def test_query(spark):
    rows = tx.op6_toxicity(spark, SF).collect()
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(rows) == n and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_operator_keeps_rows(spark):
    texts, labels = corpus(300, 3)
    docs = frame(spark, [*texts, None, ""])
    known = spark.createDataFrame([(i, y) for i, y in enumerate(labels)] + [(0, None), (10**6, 1), (None, 1)], "doc_id long, toxic int")
    model = tx.train(docs, known)
    out = tx.score(docs.withColumn("Score", F.lit("old")).withColumn("rest", F.lit(1)), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "rest", "score"] and out.count() == 302
    again = tx.score(docs.unionByName(docs), model).groupBy("doc_id").agg(F.count_distinct("score").alias("n"), F.count("score").alias("m")).collect()
    assert all((r.n, r.m) == (1, 2) for r in again)
    assert tx.score(spark.createDataFrame([], DOCS), model).collect() == []


def test_accuracy_on_rows_that_trained_nothing(spark):
    """Rows that may be learnt from, split once more: held-out labels play no part."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(~tx.held_out())
    aside = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = tx.train(docs, labels.where(~aside))
    rows = tx.score(docs.join(labels.where(aside), "doc_id"), model).select("toxic", "score").collect()
    hit = sum(r.score >= tx.THRESHOLD and r.toxic for r in rows)
    f1 = 2 * hit / (sum(r.score >= tx.THRESHOLD for r in rows) + sum(r.toxic for r in rows))
    assert f1 > 0.6, f1
