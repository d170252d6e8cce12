import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from coppice.llm import suffix_dedup as sd
from tests.llm.fixtures import DOCS, SF, frame, prose


def brute(texts):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in data for i in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - 199):
            if count[b[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def result(docs, **how):
    rows = sd.remove_repeats(docs, digest=True, **how).select("doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept"))).collect()
    return [tuple(r)[1:] for r in sorted(rows, key=lambda r: (r[0] is not None, r[0]))]


def test_trie_and_multikey_sort_like_sorted():
    r = random.Random(3)
    for _ in range(30):
        strings = [bytes(r.choice(b"\0ab") for _ in range(r.randint(0, 60))) for _ in range(r.randint(1, 40))]
        strings = [(b"a" * 40 + s)[:160] if r.random() < 0.7 else s for s in strings]
        assert [strings[i] for i in sd.blind_trie_order(strings)] == sorted(strings)
        order, lcp = sd.deep_shallow(strings, sd.np.zeros(len(strings), int), 160)
        got = [strings[i] for i in order]
        assert got == sorted(strings)
        for a, b, n in zip(got, got[1:], lcp[1:]):
            assert a[:n] == b[:n] and (n in (len(a), len(b)) or a[n] != b[n])


def test_edge_cases(spark):
    passage, base = prose(1, 70), prose(2, 300)
    r = random.Random(5)
    texts = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "é" * 400, base, base, passage + " " + prose(9, 40), base[:900] + "XYZ" + base[903:], base[50:700]]
    texts += [prose(20 + i, 30) + " " + passage + " " + prose(60 + i, 25) for i in range(12)]
    texts += ["ab" * 400, "xab" + "ab" * 150 + "y", passage[:205], passage[3:]]
    for i in range(8):
        words = base.split(" ")
        for _ in range(3):
            words[r.randrange(len(words))] = "edited%d" % i
        texts.append(" ".join(words))
    want = brute(texts)
    assert result(frame(spark, texts).repartition(3)) == want
    assert result(frame(spark, texts).repartition(3), group=4, hot=3) == want
    assert result(frame(spark, texts).repartition(3), group=1, hot=2) == want


def test_parts_of_a_common_gram_are_bounded_and_lose_no_window(spark):
    """Texts that share a passage, some of them with a few bytes around it too, so that windows match across parts."""
    r, passage = random.Random(11), prose(1, 60)
    sides = [prose(100 + k, 12) for k in range(12)]
    texts = [r.choice(sides)[-r.randint(1, 60) :] + passage + r.choice(sides)[: r.randint(1, 60)] + prose(500 + i, 9) for i in range(150)]
    assert result(frame(spark, texts).repartition(6), group=16, hot=4) == brute(texts)
    many = [prose(1000 + i, 6)[:40] + passage + prose(5000 + i, 6) for i in range(3000)]
    out = {}

    def keep(df):
        out.setdefault("cuts", []).append(cut(df))
        return out["cuts"][-1]

    cut, sd.cut = sd.cut, keep
    try:
        sd.remove_repeats(frame(spark, many), group=256).count()
    finally:
        sd.cut = cut
    state = out["cuts"][1].where("__kind = 0")
    by_gram = state.groupBy("__g").count().agg(F.max("count")).first()[0]
    assert by_gram > 2500 and state.groupBy("__g", "__sub").count().agg(F.max("count")).first()[0] < 2 * 256
    assert state.count() == state.select("__r1", "__r2", "__pos").distinct().count()


def test_rows_of_one_id_are_told_apart_by_more_than_32_bits(spark):
    words = prose(3, 60)
    rows = spark.range(400_000).select("id", F.hash(F.concat(F.lit(words + " tail "), F.col("id").cast("string"))).alias("h"))
    pair = rows.groupBy("h").agg(F.collect_list("id").alias("ids")).where("size(ids) > 1").orderBy("h").first()["ids"][:2]
    texts = [*(f"{words} tail {i}" for i in pair), prose(8, 70), prose(9, 70), "q" * 30 + words[:240]]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = sd.remove_repeats(docs, digest=True).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept).hex()) for r in rows) == sorted(brute(texts))


def test_empty_table_and_repeated_rows(spark):
    assert result(spark.createDataFrame([], DOCS)) == []
    t = prose(4, 80)
    docs = spark.createDataFrame([(1, t), (1, t), (2, "x"), (None, t[:300])], "doc_id long, text string")
    assert [x[1] for x in result(docs)] == [300 - 0 if len(t[:300].encode()) == 300 else len(t[:300].encode()), len(t.encode()), len(t.encode()), 0]


def test_other_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "x", 5, "k", 7, "z")], "doc_id long, text string, __g int, n_bytes string, __r1 int, N_Removed string")
    out = sd.remove_repeats(docs)
    assert out.columns == ["doc_id", "__g", "__r1", "n_bytes", "n_removed", "n_spans", "kept"]
    assert [tuple(r) for r in out.collect()] == [(1, 5, 7, 1, 0, 0, bytearray(b"x"))]


def test_a_text_of_several_pieces(spark):
    """Windows that cross the places where a very long text is cut into pieces."""
    long = prose(4, 260_000, vocabulary=3000)
    assert len(long.encode()) > sd._PIECE + 1000
    edge = long.encode()[sd._PIECE - 400 : sd._PIECE + 300].decode(errors="ignore")
    texts = [long, prose(5, 40) + edge + prose(6, 40), "x" * (sd._PIECE + 500)]
    assert result(frame(spark, texts)) == brute(texts)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = sorted(tuple(r) for r in sd.op1_suffix_dedup(spark, SF).collect())
    assert got == [(d.doc_id, *x) for d, x in zip(docs, brute([d.text for d in docs]))]
