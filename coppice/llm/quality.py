"""Quality rules as a short-circuit cascade, in Spark functions only.

The base measures are exact counts over the whole text.  The further rules reject a text by themselves, so their order
changes the cost but not the verdict.  On a sample (distinct texts of at most SAMPLE_BYTES bytes whose hash is low enough
for about SAMPLE of them) the base measures are taken once and kept; a rule's cost is the time that asking it adds to a pass over them, and its
rejections are counted among the texts that the base and the rules before it let through.  Rules are asked by falling
rejections per cost in one CASE, which stops at the first that rejects.

Repeated three-word windows are found without leaving the row: windows sorted with their positions put equal ones side
by side (n log n), and texts whose windows' hashes all differ skip the sort.  No shuffle is needed.

Defined cases: null text counts as empty (no words, base_failed); a very long text is handled whole; repeated rows give
repeated results; an empty table gives an empty result; other columns pass through (not those named as a result is).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm._arrow import other_columns
from coppice.llm._native import BLANKS, indexes, let, words
from coppice.plans.lineage import cut

SYMBOLS = "#*$%&|<>"
SAMPLE = 400
SAMPLE_BYTES = 1 << 16
REPEATS = 3
FLOOR = 0.1  # costs under this share of a bare pass can't be told from noise and count as it


class Text(NamedTuple):
    """What rules may look at."""

    text: Column
    words: Column
    lines: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column
    n_repeat_words: Column


# Thresholds in the manner of published heuristics for web text.
RULES = {
    "symbols": lambda x: x.n_symbols * 10 > x.n_words,
    "duplicate_lines": lambda x: x.n_dup_lines * 3 > F.size(x.lines),
    "repeated_words": lambda x: x.n_repeat_words * 100 > x.n_words * 30,
    "word_length": lambda x: (x.word_chars < x.n_words * 3) | (x.word_chars > x.n_words * 12),
    "words_without_letters": lambda x: F.size(F.filter(x.words, lambda w: w.rlike(r"\p{L}"))) * 100 < x.n_words * 80,
    "ellipsis_lines": lambda x: F.size(F.filter(x.lines, lambda s: s.rlike(r"(\.\.\.|…)[\x20\t\r]*$"))) * 10 > F.size(x.lines) * 3,
    "bullet_lines": lambda x: F.size(F.filter(x.lines, lambda s: s.rlike(r"^[\x20\t]*[-*•‣]"))) * 10 > F.size(x.lines) * 9,
}


def repeat_words(w: Column) -> Column:
    """Words inside three-word windows that the text holds twice or more."""
    starts = F.transform(indexes(F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def exact(win: Column, h: Column) -> Column:
        pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), F.get(win, i).alias("w"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, k: F.coalesce((F.get(s, k)["h"] == x["h"]) & (F.get(s, k)["w"] == x["w"]), F.lit(False))
            at = F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
            return let(at, lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

        return let(pairs, twice)

    def decide(win: Column) -> Column:
        return let(F.transform(win, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(win, h)))

    return let(starts, decide)


def _measure(text: Column, body) -> Column:
    """`body` of a Text whose parts are computed once for each row."""
    lines = F.filter(F.split(text, "\n", -1), lambda s: F.translate(s, BLANKS, "") != "")

    def with_parts(p: Column) -> Column:
        w, ls = p["words"], p["lines"]
        counts = F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
            (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeat_words(w).cast("long").alias("n_repeat_words"),
        )
        return let(counts, lambda c: body(Text(text, w, ls, *(c[k] for k in Text._fields[3:]))))

    return let(F.struct(words(text).alias("words"), lines.alias("lines")), with_parts)


def _base_failed(x: Text) -> Column:
    return (x.n_words < 50) | (x.n_repeat_words * 100 > x.n_words * 50)


def greedy_order(names: list[str], cost: dict[str, float], seen: list[tuple[frozenset, int]]) -> list[str]:
    """`names` by falling rejections per cost, each among what those before it leave; `seen` tells how many texts which
    rules reject.  Ties keep the order given."""
    order, left = [], list(names)
    while left:
        rejected = {k: sum(n for fails, n in seen if k in fails) for k in left}
        best = max(left, key=lambda k: rejected[k] / cost[k])
        order.append(best)
        left.remove(best)
        seen = [(fails, n) for fails, n in seen if best not in fails]
    return order


def _seconds(frame: DataFrame, rule: Column) -> float:
    """The quickest of REPEATS passes that read every column and ask `rule` of every row."""
    times = []
    for _ in range(REPEATS):
        began = time.perf_counter()
        frame.agg(F.sum(rule.cast("int")), *(F.count(c) for c in frame.columns)).first()
        times.append(time.perf_counter() - began)
    return min(times)


def order_rules(docs: DataFrame, text_col: str = "text", rules: dict = RULES, seconds: Callable[[DataFrame, Column], float] = _seconds) -> list[str]:
    """Names of `rules` in the order in which the cascade asks them."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    bound = int(-(1 << 63) + (1 << 64) * min(1.0, SAMPLE / max(1, docs.count()))) - 1
    texts = docs.select(text.alias("text")).where((F.octet_length("text") <= SAMPLE_BYTES) & (F.xxhash64("text") <= bound))
    few = texts.groupBy(F.xxhash64("text")).agg(F.first("text").alias("text")).limit(4 * SAMPLE)  # copies count once
    parts = lambda x: F.struct(*(getattr(x, k).alias(k) for k in Text._fields))
    kept = cut(few.select(_measure(F.col("text"), parts).alias("m")).select("m.*").coalesce(1))
    x = Text(*(F.col(k) for k in Text._fields))
    fails = {k: rule(x) for k, rule in rules.items()}
    if not fails:
        return []
    counts = kept.where(~_base_failed(x)).groupBy(*(f.alias(f"f{i}") for i, f in enumerate(fails.values()))).count().collect()  # bounded by the sample
    bare = max(seconds(kept, F.lit(False)), 1e-6)
    cost = {k: max(seconds(kept, f) - bare, FLOOR * bare) for k, f in fails.items()}
    return greedy_order(list(rules), cost, [(frozenset(k for k, f in zip(rules, r) if f), r["count"]) for r in counts])


def judge(docs: DataFrame, text_col: str = "text", rules: dict = RULES) -> DataFrame:
    """`docs` without its text, with the measures, base_failed, kept, and failed_rule (the first in the cascade that
    rejects; null if none does or base_failed)."""
    order = order_rules(docs, text_col, rules)

    def body(x: Text) -> Column:
        cascade = F.when(_base_failed(x), F.lit("base"))
        for name in order:
            cascade = cascade.when(rules[name](x), F.lit(name))
        return F.struct(*(getattr(x, k).alias(k) for k in Text._fields[3:]), cascade.alias("failed"))

    names = [*Text._fields[3:], "base_failed", "kept", "failed_rule"]
    others = other_columns(docs, text_col, *names)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    out = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), _measure(text, body).alias("m"))
    failed = F.col("m.failed")
    return out.select(*(F.col("rest").getField(c).alias(c) for c in others), *(F.col("m").getField(k).alias(k) for k in names[:5]), F.coalesce(failed == "base", F.lit(False)).alias("base_failed"), failed.isNull().alias("kept"), F.when(failed != "base", failed).alias("failed_rule"))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs).drop("failed_rule")


OP5_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
p AS (
  SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS ls
  FROM d),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) >= 3)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
m AS (
  SELECT p.doc_id, w, ls, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM p LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 3 > len(ls) OR n_repeat_words * 100 > n_words * 30
            OR word_chars < n_words * 3 OR word_chars > n_words * 12
            OR len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) * 100 < n_words * 80
            OR len(list_filter(ls, lambda s: regexp_matches(s, '(\.\.\.|…)[\x20\t\r]*$'))) * 10 > len(ls) * 3
            OR len(list_filter(ls, lambda s: regexp_matches(s, '^[\x20\t]*[-*•‣]'))) * 10 > len(ls) * 9) AS kept
FROM b
"""
