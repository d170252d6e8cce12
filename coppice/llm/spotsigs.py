"""Document fingerprints by SpotSigs, in Spark functions only.

Anchors are the corpus's most common short words (counted over all documents; the number of anchors is a parameter, so
the set that goes into the plan is bounded).  A spot signature is the hash of an anchor with the chain of the CHAIN
content words that follow it; anchors between them are skipped.  A document's fingerprint is the sorted set of its
signatures, eight hexadecimal digits each; the likeness of two fingerprints is the Jaccard coefficient of the sets,
pruned: sets whose lengths alone keep it under a floor are not intersected.

`near_classes` finds near-duplicates over all documents.  Equal fingerprints form one set; sets are partitioned by
length so that only a partition and its neighbour can hold likely pairs; postings hold each set's rarest signatures,
as many as the least overlap demands.  Each posting list is first linked through its least member; then only sets of
different components are compared, so that a group of near copies never forms all of its pairs.  Candidates are
verified by the pruned Jaccard coefficient; no list, candidate or partner is dropped.  Null ids have a class if their
text shares one with a numbered document; rows with one id and different texts are classed row by row.

A document's successor by id is found in one shuffle of the texts: ids are cut into ranges at quantiles, the first
document of a range goes to the range before as well (and the first of all to the last), and `lead` runs within ranges.

Defined cases: null text counts as empty; equal texts have equal fingerprints; a text without anchors is fingerprinted
with every word as an anchor, one without words by the hash of the text, an empty text by the empty string; two empty
fingerprints have likeness 1; null ids come first; rows with one id follow each other by text; a lone row is its own
successor; an empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm._native import indexes, let, words
from coppice.llm.graph import components
from coppice.plans.lineage import cut

ANCHORS = 96
ANCHOR_CHARS = 6
CHAIN = 2
RANGE_ROWS = 400
MOST_RANGES = 1 << 14
NEAR = 0.8
SLACK = 1e-9  # products of lengths and likenesses may be off by rounding; a wider bound loses nothing
_MARKS = ".,;:!?()\"'"


def _plain_words(text: Column) -> Column:
    return words(F.translate(F.lower(text), _MARKS, " " * len(_MARKS)))


def common_words(docs: DataFrame, text_col: str = "text", n: int = ANCHORS) -> list[str]:
    """The `n` most frequent words of at most ANCHOR_CHARS letters over all of `docs`; ties by word."""
    w = docs.select(F.explode(_plain_words(F.col(f"`{text_col}`").cast("string"))).alias("w")).where(F.char_length("w") <= ANCHOR_CHARS)
    counts = w.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in counts.orderBy(F.desc("n"), "w").limit(n).collect())


def signatures(text: Column, anchors: list[str]) -> Column:
    """The sorted set of spot signatures (array of int) of a text that isn't null."""

    def chain(w: Column, p: Column, k: Column, anchor: Column) -> Column:
        return F.hash(anchor, *(F.get(w, F.get(p, k + j)) for j in range(CHAIN)))

    def spots(w: Column) -> Column:
        is_anchor = (lambda x: x.isin(anchors)) if anchors else (lambda x: F.lit(False))
        content = F.filter(indexes(F.size(w)), lambda i: ~is_anchor(F.get(w, i)))

        def of(p: Column) -> Column:  # a content word begins a chain if an anchor stands before it
            begins = lambda i, k: F.when(F.when(k > 0, F.get(p, k - 1)).otherwise(F.lit(-1)) < i - 1, chain(w, p, k, F.get(w, i - 1)))
            return F.filter(F.transform(p, begins), lambda x: x.isNotNull())

        def every(_: Column) -> Column:
            return F.transform(w, lambda x, i: F.hash(x, *(F.get(w, i + j) for j in range(1, CHAIN + 1))))

        return let(let(content, of), lambda s: F.when(F.size(s) > 0, s).otherwise(every(s)))

    def settle(s: Column) -> Column:
        alone = F.when(text != "", F.array(F.hash(text))).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.array_distinct(F.when(F.size(s) > 0, s).otherwise(alone)))

    return let(let(_plain_words(text), spots), settle)


def fingerprint(sigs: Column) -> Column:
    return F.array_join(F.transform(sigs, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard coefficient of two signature sets; 0 without intersecting them if their lengths keep it under `floor`."""
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = let(F.size(F.array_intersect(a, b)), lambda n: n / (least + most - n))
    return F.when(most == 0, F.lit(1.0)).when((least == 0) | (least < most * floor - SLACK), F.lit(0.0)).otherwise(both.cast("double"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(range, tail, key, id, text) rows; `lead` over `succession()` gives the next document by id.

    Rows with `tail` only serve as successors.  Sorted by null ids first, then id, then text.
    """
    low = -(1 << 63)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(low)).alias("key"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    n = base.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = [k / ranges for k in range(1, ranges)] or [0.0]
    least, bounds = base.agg(F.min("key"), F.percentile_approx("key", F.array(*map(F.lit, cuts)), F.lit(10 * ranges + 100))).first()
    bounds = sorted({b for b in bounds or () if b > least})
    step = max(1, int(len(bounds) ** 0.5))
    fine = [bounds[k : k + step] for k in range(0, len(bounds), step)]  # looked up in two short steps
    last = len(bounds)
    if fine:
        heads = F.array(*(F.lit(x[0]) for x in fine))
        parts = F.array(*(F.array(*map(F.lit, x)) for x in fine))
        place = let(F.size(F.filter(heads, lambda b: b <= F.col("key"))), lambda c: F.when(c == 0, F.struct(F.lit(0).alias("at"), F.lit(False).alias("head"))).otherwise(let(F.get(parts, c - 1), lambda x: let(F.filter(x, lambda b: b <= F.col("key")), lambda y: F.struct(((c - 1) * step + F.size(y)).alias("at"), (F.element_at(y, -1) == F.col("key")).alias("head"))))))
    else:
        place = F.struct(F.lit(0).alias("at"), F.lit(False).alias("head"))
    to = lambda at, tail: F.struct(at.cast("int").alias("range"), F.lit(tail).alias("tail"))
    copies = F.array(to(F.col("p.at"), False), F.when(F.col("p.head"), to(F.col("p.at") - 1, True)), F.when(F.col("key") == F.lit(least), to(F.lit(last), True)))
    return base.withColumn("p", place).withColumn("c", F.explode(F.filter(copies, lambda x: x.isNotNull()))).select("c.range", "c.tail", "id", "key", "text")


def succession():
    return Window.partitionBy("range").orderBy("tail", "key", "text")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: int = ANCHORS) -> DataFrame:
    """For each document: n_chars, the fingerprints of its text and of its edited text, and likenesses of the first to
    the second and to the next document's."""
    common = common_words(docs, text_col, anchors)
    rows = with_next(docs, id_col, text_col).withColumn("sigs", signatures(F.col("text"), common))
    rows = rows.withColumn("next_text", F.lead("text").over(succession())).withColumn("next_sigs", F.lead("sigs").over(succession())).where("not tail")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    rows = rows.select("id", n.cast("long").alias("n_chars"), "sigs", "next_sigs", F.concat(F.substring("text", F.lit(1), n - k), F.substring("next_text", F.lit(1), k)).alias("edited"))
    rows = rows.withColumn("e", let(F.col("edited"), lambda t: F.struct(F.sha2(t.cast("binary"), 256).alias("sha"), signatures(t, common).alias("sigs"))))
    both = let(F.col("e"), lambda e: F.struct(e["sha"].alias("edited_sha256"), fingerprint(e["sigs"]).alias("edited_fingerprint"), likeness(F.col("sigs"), e["sigs"]).alias("near_edited")))
    rows = rows.select("id", "n_chars", fingerprint(F.col("sigs")).alias("fingerprint"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"), both.alias("x"))
    return rows.select(F.col("id").alias(id_col), "n_chars", "x.edited_sha256", "fingerprint", "x.edited_fingerprint", "x.near_edited", "near_next")


def _alike_lengths(a: Column, b: Column, at_least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * at_least - SLACK


def _postings(sets: DataFrame, at_least: float) -> DataFrame:
    """(part, sig, node, n, home): the signatures by which a set must meet any other of likeness `at_least`.

    Partition boundaries grow by 1 / at_least; a set is at home in its length's partition and visits the ones above
    that hold lengths it may match.  Signatures held by one set only come first in the order and meet nothing.
    """
    each = sets.select("node", "n", F.explode("sigs").alias("sig"))
    counts = each.groupBy("sig").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(counts, "sig").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "sig"))).alias("shared"))
    n, step = F.col("n"), F.log(F.lit(1 / at_least))
    need = n - F.ceil(n * at_least - SLACK) + 1 - (n - F.size("shared"))
    home, top = F.floor(F.log(n) / step).cast("int"), F.floor(F.log(n / at_least + 1e-6) / step).cast("int")
    rows = shared.select("node", "n", F.slice("shared", F.lit(1), F.greatest(need, F.lit(0)).cast("int")).alias("first"), home.alias("at"), top.alias("top"))
    rows = rows.select("node", "n", "at", "top", F.explode("first.sig").alias("sig"))
    rows = rows.select("sig", "node", "n", "at", F.explode(F.sequence("at", F.greatest("at", "top"))).alias("part"))
    return rows.select("part", "sig", "node", "n", (F.col("part") == F.col("at")).alias("home"))


def _verified(pairs: DataFrame, sets: DataFrame, at_least: float) -> DataFrame:
    """Those (a, b) of `pairs` whose sets are alike."""
    side = lambda x: sets.select(F.col("node").alias(x), F.col("sigs").alias(f"{x}_sigs"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.where(likeness(F.col("a_sigs"), F.col("b_sigs"), at_least) >= at_least).select("a", "b")


def _ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _links(sets: DataFrame, at_least: float) -> DataFrame:
    """(a, b) links that connect whatever sets of likeness `at_least` connect."""
    postings = cut(_postings(sets, at_least))
    lists = ["part", "sig"]
    leads = postings.where("home").groupBy(lists).agg(F.min(F.struct("node", "n")).alias("lead"))
    to_lead = postings.join(leads, lists).where(F.col("node") != F.col("lead.node")).where(_alike_lengths(F.col("n"), F.col("lead.n"), at_least))
    tree = components(_verified(to_lead.select(*_ordered(F.col("node"), F.col("lead.node"))).distinct(), sets, at_least))
    placed = cut(postings.join(tree, "node", "left").select(*lists, F.coalesce("root", "node").alias("comp"), "node", "n", "home"))
    side = lambda df, x, *cols: df.select(*lists, *(F.col(c).alias(f"{x}_{c}") for c in cols))
    held = placed.groupBy(*lists, "comp").agg(F.max("home").alias("home"))
    apart = side(held, "x", "comp", "home").join(side(held, "y", "comp", "home"), lists).where("x_comp < y_comp and (x_home or y_home)").drop("x_home", "y_home")
    members = ("comp", "node", "n", "home")
    met = apart.join(side(placed, "x", *members), [*lists, "x_comp"]).join(side(placed, "y", *members), [*lists, "y_comp"])
    met = met.where("x_home or y_home").where(_alike_lengths(F.col("x_n"), F.col("y_n"), at_least))
    rest = _verified(met.select(*_ordered(F.col("x_node"), F.col("y_node"))).distinct(), sets, at_least)
    return rest.unionByName(tree.select(*_ordered(F.col("node"), F.col("root"))))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = NEAR, anchors: int = ANCHORS) -> DataFrame:
    """One row for each row of `docs`: its id and class_id (long), the smallest id reachable over likenesses of at
    least `at_least` (over 0, at most 1)."""
    if not 0 < at_least <= 1:
        raise ValueError("at_least must be over 0 and at most 1")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), signatures(text, common_words(docs, text_col, anchors)).alias("sigs"))
    rows = cut(rows.withColumn("key", F.sha2(fingerprint(F.col("sigs")), 256)))
    least = rows.groupBy("key").agg(F.min("id").alias("least"), F.first("sigs").alias("sigs"))
    sets = cut(least.select("key", "least", "sigs", F.size("sigs").alias("n"), F.monotonically_increasing_id().alias("node")))
    root = F.col("node")
    if at_least < 1:
        tree = components(_links(sets.where("n > 0").select("node", "n", "sigs"), at_least))
        sets, root = sets.join(tree, "node", "left"), F.coalesce("root", "node")
    named = sets.select("key", "least", root.alias("class"))
    ids = named.groupBy("class").agg(F.min("least").alias("class_id"))
    return rows.select("id", "key").join(named.select("key", "class"), "key").join(ids, "class").select(F.col("id").alias(id_col), "class_id")


def op10_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
