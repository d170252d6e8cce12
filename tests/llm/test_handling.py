"""Every operator and pipeline stage on columns with clashing names, empty tables, repeated rows, nulls and long texts."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from coppice.llm import bpe, html_text, packing, quality, secrets, simhash, spotsigs, suffix_dedup, toxicity, url_filter
from coppice.llm.graph import components
from coppice.plans import skew
from tests.llm.fixtures import SF, prose

TEXTS = [None, "", " ", "word", prose(1, 90), prose(1, 90), prose(2, 60) + " password=abcdefgh12", "x" * 300_000, "é " * 40_000]
#: Names of results (in other cases too), of columns that plans use inside, and plain ones.
CLASHES = ["Score", "KEPT", "n_removed", "Found", "redacted", "fp", "Component_ID", "root_fp", "ids", "Decoded", "host", "PATH", "rule", "verdict", "n_words", "failed_rule", "N_Chars", "fingerprint", "rest", "b", "m", "__rest", "__text", "__r1", "__g", "__salt", "__row", "__text_hash", "__hot", "salt", "bucket", "spread", "rank", "piece", "length", "key", "p", "c", "sigs", "label"]


def table(spark, text_col="text", repeat=True):
    rows = [(i if i != 3 else None, t) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows + (rows[4:7] if repeat else []), f"doc_id long, {text_col} string")
    return docs.select("*", *(F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES if c.lower() != text_col))


def model():
    texts = [prose(k, 40) + (" vile" if k % 2 else "") for k in range(40)]
    return toxicity.fit(texts, [k % 2 for k in range(40)])


OPERATORS = {
    "suffix_dedup": (lambda d: suffix_dedup.remove_repeats(d), "text", ("n_bytes", "n_removed", "n_spans", "kept")),
    "url_filter": (lambda d: url_filter.judge(d, url_filter.RULES), "url", ("host", "path", "rule", "verdict")),
    "url_filter_join": (lambda d: url_filter.judge_by_join(d, d.sparkSession.createDataFrame(url_filter.RULES, "rule string, verdict string")), "url", ("host", "path", "rule", "verdict")),
    "secrets": (lambda d: secrets.find_secrets(d), "text", ("found", "redacted")),
    "html_text": (lambda d: html_text.extract(d), "html", ("text", "n_chars")),
    "quality": (lambda d: quality.judge(d), "text", ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed_rule")),
    "toxicity": (lambda d: toxicity.score(d, model()), "text", ("score",)),
    "simhash": (lambda d: simhash.near_components(d, root=True), "text", ("fp", "component_id", "root_fp")),
    "bpe": (lambda d: bpe.encode(d), "text", ("ids", "decoded")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operators_keep_other_columns(spark, name):
    operator, text_col, results = OPERATORS[name]
    docs = table(spark, text_col)
    if name.startswith("url"):
        docs = docs.withColumn("url", F.when(F.length("url") > 100, F.concat(F.lit("http://a.net/"), F.col("url"))).otherwise(F.col("url")))
    out = operator(docs)
    own = [c for c in CLASHES if c.lower() not in results and c.lower() != text_col]
    assert set(own) <= set(out.columns) and set(results) <= set(out.columns)
    got, want = ([tuple(r) for r in df.select("doc_id", *(f"`{c}`" for c in own)).collect()] for df in (out, docs))
    assert Counter(got) == Counter(want)
    again = Counter(tuple(map(str, r)) for r in out.select("doc_id", *results).collect())
    assert all(n % 2 == 0 for r, n in again.items() if r[0] in ("4", "5", "6"))  # rows that occur twice have one result
    empty = operator(docs.limit(0))
    assert empty.collect() == [] and empty.columns == out.columns


@pytest.mark.parametrize("operator", [lambda d: packing.pack_documents(d), lambda d: spotsigs.fingerprint_documents(d), lambda d: spotsigs.near_classes(d)])
def test_operators_that_carry_no_columns(spark, operator):
    docs = table(spark)
    rows = operator(docs).collect()
    assert Counter(r.doc_id for r in rows) >= Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert operator(docs.limit(0)).collect() == []


@pytest.mark.parametrize("stage", [s for s, _ in cp.STAGES])
def test_stages_keep_all_columns(spark, stage):
    docs, run = table(spark), dict(cp.STAGES)[stage]
    out, empty = run(spark, docs, SF), run(spark, docs.limit(0), SF)
    assert empty.collect() == []
    if stage == cp.STAGES[-1][0]:
        return
    assert out.columns == docs.columns == empty.columns
    fixed = [c for c in docs.columns if c != "text" and (c.lower() != "n_chars" or stage in ("toxicity", "simhash_near_dedup"))]
    got, want = (Counter(tuple(r) for r in df.select(*(f"`{c}`" for c in fixed)).collect()) for df in (out, docs))
    assert all(n <= want[r] for r, n in got.items())
    least = {"toxicity": 9, "simhash_near_dedup": 6}.get(stage, sum(want.values()))
    assert sum(got.values()) >= least
    if stage in ("suffix_array_dedup", "secret_scan"):
        assert got == want and all(r[0] is None or str(len(r[1] or "")) == r[0] for r in out.select("N_Chars", "text").collect())


def test_hot_keys_are_dealt_out(spark):
    many = spark.range(2000).select(F.when(F.col("id") < 1500, 7).otherwise(F.col("id")).alias("k"), "id")
    one = many.select("k").distinct().withColumn("v", F.col("k") * 10)
    hot = many.groupBy("k").count().where("count > 100").select("k")
    out = skew.join_hot(many, one, "k", hot)
    assert out.columns == ["k", "id", "v"] and out.count() == 2000 and out.where("v <> k * 10").isEmpty()
    assert skew.join_hot(many, one, "k", hot.limit(0)).count() == 2000
    maps = many.withColumn("m", F.create_map(F.lit("a"), F.col("id")))
    assert skew.join_hot(maps, one, "k", hot).count() == 2000


def test_components_with_hubs(spark, monkeypatch):
    from coppice.llm import graph

    monkeypatch.setattr(graph, "HOT", 20)
    edges = [(0, i) for i in range(1, 200)] + [(1000, i) for i in range(1001, 1100)] + [(1099, 150)] + [(5000, 5001)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert len(got) == 302 and {got[i] for i in got if i < 5000} == {0} and got[5001] == 5000


def test_packing_with_buckets(spark, monkeypatch):
    """Ranks within a common length come from several buckets, whatever the ids."""
    monkeypatch.setattr(packing, "CELL", 10)
    docs = spark.createDataFrame([(None, "a b")] * 60 + [(1, "a b c d")] * 45 + [(2, "z")] * 7, "doc_id long, text string")
    rows = packing.pack_documents(docs, length=8).collect()
    assert len(rows) == 112
    room = {}
    for r in rows:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for v in room.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 8
