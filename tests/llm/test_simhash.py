import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from coppice.llm import simhash as sh
from coppice.llm.graph import components
from tests.llm.fixtures import DOCS, SF, frame, prose


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def plain_components(ids, fps):
    label = list(range(len(fps)))
    f = np.array(fps, np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [a if x == b else x for x in label]
    return [min((ids[j] for j in range(len(ids)) if label[j] == label[i] and ids[j] is not None), default=None) for i in range(len(ids))]


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    want = sorted((str(r.doc_id), fp, c) for r, fp, c in zip(rows, fps, plain_components([r.doc_id for r in rows], fps)))
    got = sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in sh.near_components(docs).collect())
    assert got == want


def test_awkward_cases(spark):
    r = random.Random(1)
    base = prose(2, 400)
    texts = [None, "", " \n", "One", "one", "ONE two", "a b c", "É a b", base, base, "%s" % ("word " * 20000)]
    for _ in range(60):
        w = base.split(" ")
        for _ in range(r.randint(1, 6)):
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    check(frame(spark, texts))
    check(spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "zz")], "doc_id long, text string"))
    assert sh.near_components(spark.createDataFrame([], DOCS)).collect() == []


def test_dense_cells_in_chunks(spark, monkeypatch):
    r = random.Random(4)
    centre = r.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for _ in range(500)} | {r.getrandbits(64) for _ in range(300)}
    fps = sorted(fps)
    want = plain_components(fps, fps)
    for cell in (4096, 40):
        monkeypatch.setattr(sh, "CELL", cell)
        signed = [x - 2**64 if x >= 2**63 else x for x in fps]
        tree = components(sh.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
        groups = {}
        for node, root in tree.collect():
            groups.setdefault(root, set()).add(node % 2**64)
        parts = {}
        for x, c in zip(fps, want):
            parts.setdefault(c, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(sorted(p) for p in parts.values() if len(p) > 1)


def test_bound_never_exceeds_distance():
    a = np.random.default_rng(0).integers(0, 2**63, 5000, dtype=np.uint64)
    b = a ^ (np.uint64(1) << np.random.default_rng(1).integers(0, 64, 5000).astype(np.uint64))
    assert (sh.manhattan(a, b) <= 1).all() and (sh.manhattan(a, a[::-1]) <= np.bitwise_count(a ^ a[::-1])).all()


def test_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "a long, b long")
    got = dict(tuple(x) for x in components(edges).collect())
    assert all(got[i] == 0 for i in range(201)) and got[501] == got[500] == 500


def test_query(spark):
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    q = sh.op7_simhash(spark, SF)
    assert q.columns == ["doc_id", "fingerprint", "component_id"] and {len(r.fingerprint) for r in q.collect()} == {16}


def test_cells_are_not_broadcast(spark):
    """A small source gives some fifty times as many rows of cells."""
    plan = sh.links(spark.range(1000).select(F.xxhash64("id").alias("fp")))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
