import hashlib
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from coppice.llm import quality, spotsigs
from coppice.llm.graph import components
from tests.llm.fixtures import DOCS, SF, frame, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(t):
    w = WORD.findall(t or "")
    g = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(g)
    cov = {i + k for i, x in enumerate(g) if n[x] > 1 for k in range(3)}
    lines = [s for s in (t or "").split("\n") if WORD.search(s)]
    m = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cov))
    return (*m, len(w) < 50 or 100 * len(cov) > 50 * len(w))


ODD = [None, "", " \n\t", "a", "a b c", "a b c a b c", "x x x x x", "l1 a\nl1 a\n\nl1 a\r\nz", "é $ # & é\x0b\x0cq \x85 \xa0", "w " * 20000, " ".join(["same words here now"] * 400), "…\n" * 3, "\n".join("- " + prose(i, 8) for i in range(12)), "\n".join(prose(i, 8) + " ..." for i in range(12)), "# $ % " * 60 + prose(3, 60), "1 2 3 4 " * 20 + prose(4, 20)]


def test_quality(spark):
    texts = ODD + [prose(i, 80) for i in range(10)]
    rows = {r.doc_id: r for r in quality.judge(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_measures(t), t
        assert not (r.base_failed and r.kept)
        assert r.kept == (i >= len(ODD)), (i, r)
    assert quality.judge(spark.createDataFrame([], DOCS)).collect() == []
    clash = spark.createDataFrame([(1, "x", 9, "p", 1)], "doc_id long, text string, N_Words int, words string, m int")
    assert quality.judge(clash).first()["n_words"] == 1 and quality.judge(clash).columns[:3] == ["doc_id", "words", "m"]


def test_quality_query_equals_sql(spark):
    got = quality.op5_quality_rules(spark, SF)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.execute(quality.OP5_SQL)
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
    assert set(quality.order_rules(spark.read.parquet(f"{SF}/documents.parquet"))) == set(quality.RULES)


def test_rules_are_ordered_by_rejections_for_their_own_cost(spark):
    docs = frame(spark, [prose(i, 60) + (" yes" if i % 2 else " no") + (" rare" if i < 3 else "") for i in range(30)] + ["short", None])
    slow = lambda x: F.size(F.filter(x.words, lambda w: F.exists(F.sequence(F.lit(1), F.lit(300)), lambda i: F.sha2(F.concat(w, i.cast("string")), 512) == ""))) >= 0
    rules = {"slow": slow, "never": lambda x: x.n_words < 0, "rare": lambda x: F.array_contains(x.words, "rare"), "half": lambda x: F.array_contains(x.words, "yes")}
    assert quality.order_rules(docs, rules=rules)[0] == "half" and quality.order_rules(docs, rules=rules) == quality.order_rules(docs, rules=rules)
    assert quality.order_rules(docs, rules={"slow": slow, "half": rules["half"]}) == ["half", "slow"]
    same = lambda frame, rule: 1.0
    assert quality.order_rules(docs, rules=rules, seconds=same) == ["slow", "never", "rare", "half"]  # the first leaves nothing
    del rules["slow"]
    assert quality.order_rules(docs, rules=rules, seconds=same) == ["half", "rare", "never"]
    assert quality.order_rules(docs, rules={}) == [] and quality.order_rules(spark.createDataFrame([], DOCS), rules=rules) == list(rules)
    # b rejects more at first, but nothing that a has left
    assert quality.greedy_order(["b", "a", "c"], {"a": 1, "b": 2, "c": 1}, [(frozenset("ab"), 10), (frozenset("b"), 1), (frozenset("c"), 5)]) == ["a", "c", "b"]


def plain_signatures(t, anchors):
    for c in ".,;:!?()\"'":
        t = t.replace(c, " ")
    w = WORD.findall(t.lower())
    content = [i for i, x in enumerate(w) if x not in anchors]
    at = lambda i: w[i] if i is not None and i < len(w) else None
    out = set()
    for k, i in enumerate(content):
        if i > 0 and w[i - 1] in anchors:
            out.add((w[i - 1], w[i], at(content[k + 1] if k + 1 < len(content) else None)))
    return out or {(x, at(i + 1), at(i + 2)) for i, x in enumerate(w)}


def check_fingerprints(spark, docs, rows):
    """docs: (id, text) in order of succession."""
    anchors = set(spotsigs.common_words(spark.createDataFrame([(t,) for _, t in docs], "text string")))
    counts = Counter(x for _, t in docs for x in WORD.findall((t or "").translate(str.maketrans(spotsigs._MARKS, " " * 10)).lower()) if len(x) <= 6)
    assert sorted(anchors) == sorted(sorted(counts, key=lambda x: (-counts[x], x))[: spotsigs.ANCHORS])
    jaccard = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows)
    want, prints = Counter(), {}
    whole = lambda t: plain_signatures(t, anchors) or ({t} if t else set())
    for k, (i, t) in enumerate(docs):
        t, after = t or "", docs[(k + 1) % len(docs)][1] or ""
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b = whole(t), whole(edited)
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(a, b), 9), round(jaccard(a, whole(after)), 9)] += 1
        prints[i, hashlib.sha256(edited.encode()).hexdigest()] = (len(a), len(b))
    assert got == want
    for r in rows:
        assert (len(r.fingerprint) // 8, len(r.edited_fingerprint) // 8) == prints[r.doc_id, r.edited_sha256]


def test_spotsigs(spark, monkeypatch):
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 3)
    texts = [None, "", " ", "Alone", "of", "the of to", "…", *(prose(i, 30, 60) + " the " + prose(i, 20, 60) + ". Of " for i in range(25)), "x y " * 5000]
    check_fingerprints(spark, list(enumerate(texts)), spotsigs.fingerprint_documents(frame(spark, texts).repartition(4)).collect())
    twice = [(None, "a"), (1, "b the c"), (1, "b the c"), (1, "c of d"), (2, "e" * 9)]
    check_fingerprints(spark, twice, spotsigs.fingerprint_documents(spark.createDataFrame(twice[::-1], "doc_id long, text string")).collect())
    check_fingerprints(spark, [(7, "only the one")], spotsigs.fingerprint_documents(spark.createDataFrame([(7, "only the one")], "doc_id long, text string")).collect())
    assert spotsigs.fingerprint_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_spotsigs_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    q = spotsigs.op10_spotsigs(spark, SF)
    rows = q.collect()
    check_fingerprints(spark, docs, rows)
    assert sum(r.near_edited > 0.4 for r in rows) > 0.8 * len(rows) and sum(r.near_next > 0.2 for r in rows) < 0.1 * len(rows)
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    equal = spotsigs.fingerprint_documents(frame(spark, ["the b c d", "x", "the b c d"]))
    assert len({r.fingerprint for r in equal.collect()}) == 2
    assert spark.range(1).select(spotsigs.likeness(F.array(F.lit(1)), F.array(*map(F.lit, range(9))), 0.5)).first()[0] == 0


def plain_classes(docs, anchors, at_least):
    """docs: (id, text); Counter of (id, class id) by comparing all pairs of texts."""
    sets = [plain_signatures(t or "", anchors) or ({t} if t else set()) for _, t in docs]
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if label[i] != label[j] and (a == b or (a and b and len(a & b) / len(a | b) >= at_least)):
                label = [label[j] if x == label[i] else x for x in label]
    least = {x: min((i for (i, _), y in zip(docs, label) if y == x and i is not None), default=None) for x in label}
    return Counter((i, least[x]) for (i, _), x in zip(docs, label))


def test_spotsigs_near_classes(spark):
    base = [prose(i, 60, 90).split() for i in range(6)]
    texts = [None, "", "…", "of", "x y " * 3000, *(" ".join(b) for b in base)]
    for k, b in enumerate(base):  # near copies, chains of them, and longer and shorter ones
        for j in range(9):
            edited = [*b[: len(b) - j * (k + 1)], *(f"the new{k}x{x}" for x in range(j))]
            edited[j] = "changed"
            texts.append(" the ".join(edited))
    docs = list(enumerate(texts)) + [(None, texts[6]), (None, "no other has this"), (3, "of"), (3, " ".join(base[0]))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit("taken")).repartition(4)
    anchors = set(spotsigs.common_words(rows))
    for at_least in (0.3, 0.6, 0.8, 1.0):
        got = spotsigs.near_classes(rows, at_least=at_least)
        assert Counter((r.doc_id, r.class_id) for r in got.collect()) == plain_classes(docs, anchors, at_least), at_least
    assert spotsigs.near_classes(spark.createDataFrame([], DOCS)).collect() == []
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())


def test_spotsigs_near_classes_of_a_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    anchors = set(spotsigs.common_words(rows))
    got = Counter((r.doc_id, r.class_id) for r in spotsigs.near_classes(rows).collect())
    assert got == plain_classes(docs, anchors, spotsigs.NEAR)
    assert len({c for _, c in got}) < len(docs)


def check_links(spark, sets, at_least):
    label = {k: k for k in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if label[i] != label[j] and len(a & b) / len(a | b) >= at_least:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    rows = spark.createDataFrame([(k, len(v), sorted(v)) for k, v in sets.items()], "node long, n int, sigs array<int>")
    got = {r.node: r.root for r in components(spotsigs._links(rows, at_least)).collect()}
    assert {k: got.get(k, k) for k in sets} == label
    return label


def test_spotsigs_links_apart_from_the_lead(spark):
    """Sets 1 and 2 are alike and meet only in lists led by set 0, which is like neither."""
    common = {*range(4, 10), *range(21, 28)}
    sets = {0: {1, 2, 3, *range(21, 28)}, 1: set(range(1, 11)), 2: {*range(1, 10), 11}}
    sets |= {100 + k: common | set(range(1000 * (k + 1), 1000 * (k + 1) + 20)) for k in range(5)}
    label = check_links(spark, sets, 0.8)
    assert label[1] == label[2] == 1 and label[0] == 0


def test_spotsigs_links_of_random_sets(spark):
    r = random.Random(5)
    distinct = {frozenset(r.sample(range(24), r.randint(1, 12))) for _ in range(120)}
    assert len(set(check_links(spark, dict(enumerate(sorted(map(set, distinct), key=sorted))), 0.7).values())) > 10
