"""Queries of the engine itself: partitioners, behaviors, decompositions, loops, the tuner and the text formats."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions import stats
from coppice.operators import balance, loops, ranges, workloads
from coppice.operators.problem import Body, Problem, Serial, levels_for_tasks
from coppice.plans import decompose, granularity, tune
from coppice.plans.behavior import Behavior
from coppice.plans.decompose import Decomposition, Policy
from coppice.plans.evaluate import evaluate, evaluate_test, evaluate_tree, replicated
from coppice.plans.lineage import scratch
from coppice.sources import text
from coppice.workload_queries import _MIDPOINT, ORACLE_SQL, QUERIES, _bodies, _items, _midpoint_body, _read, _runs, _whole, query

_BEFORE = set(QUERIES)
_SUM = _MIDPOINT.format(end=4095) + "SELECT sum(s)::BIGINT AS total, count(*) AS leaves FROM t WHERE s = e"
_FIB = "WITH RECURSIVE t(n) AS (SELECT {n} UNION ALL SELECT n - k FROM t, (VALUES (1), (2)) v(k) WHERE n >= 2) "


def _fib(whole: bool = False) -> Problem:
    """n -> n - 1, n - 2, with its Python form; `whole`: sub-trees by a closed loop in place of the walk."""
    children = lambda: F.array(*(F.struct((F.col("n") - k).alias("n")) for k in (1, 2)))

    def loop(node: dict) -> dict:
        a, b = 0, 1
        for _ in range(node["n"]):
            a, b = b, a + b
        return {"fib": a}

    serial = Serial(lambda x: x["n"] < 2, lambda x: [{"n": x["n"] - 1}, {"n": x["n"] - 2}], lambda x: {"fib": x["n"]}, combine=lambda x, of: {"fib": sum(v["fib"] for v in of)}, whole=loop if whole else None)
    return Problem(("n",), lambda: F.col("n") < 2, children, arity=2, do_parallel=lambda: F.col("n") > 12, cost=lambda: F.pow(F.lit(1.618), F.col("n")), serial=serial)


def _fib_body() -> Body:
    return Body({"fib": lambda: F.col("n").cast("long")}, {"fib": F.sum})


def _one(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(n,)], "n int")


# ---- granularity ----------------------------------------------------------------------------------------------


@query(_FIB.format(n=18) + "SELECT sum(n) FILTER (n < 2)::BIGINT AS fib FROM t")
def fold_custom(spark, sf_dir):
    """Rows are dealt out while `do_parallel` holds; sub-trees below end within tasks."""
    return evaluate(_one(spark, 18), _fib(), _fib_body(), granularity.CUSTOM).value


@query(_FIB.format(n=18) + "SELECT sum(n) FILTER (n < 2)::BIGINT AS fib FROM t")
def fold_automatic(spark, sf_dir):
    return evaluate(_one(spark, 18), _fib(), _fib_body(), granularity.AUTOMATIC, tasks=16).value


@query(_FIB.format(n=18) + "SELECT sum(n) FILTER (n < 2)::BIGINT AS fib FROM t")
def fold_serial(spark, sf_dir):
    """The sequential evaluator: the whole tree on one stack."""
    return evaluate(_one(spark, 18), _fib(), _fib_body(), granularity.SERIAL).value


@query("WITH RECURSIVE f(k, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 60) SELECT a AS fib FROM f WHERE k = 60")
def serial_function(spark, sf_dir):
    """Sub-trees by the user's own function in place of the walk."""
    return evaluate(_one(spark, 60), _fib(whole=True), _fib_body(), granularity.AUTOMATIC, tasks=8).value


@query(_SUM)
def fold_budget(spark, sf_dir):
    """Tasks walk few nodes at a time; what is left open is dealt out again."""
    values = T.StructType([T.StructField(k, T.LongType()) for k in ("total", "leaves")])
    rows = granularity.contributions(_whole(spark, 4095), ranges.midpoint_split(), values, granularity.SERIAL, budget=1500)
    return rows.agg(F.sum("total").alias("total"), F.sum("leaves").alias("leaves"))


def _tree_query(partitioner: str):
    """The leaves of a range in order, as text: the combination depends on the order of children."""

    def run(spark, sf_dir):
        p = ranges.midpoint_split()
        serial = Serial(p.serial.is_base, p.serial.children, lambda x: {"value": str(x["start"])}, combine=lambda x, of: {"value": ",".join(v["value"] for v in of)})
        problem = Problem(p.payload, p.is_base, p.children, arity=2, do_parallel=lambda: F.col("end") - F.col("start") > 20, serial=serial)
        out = evaluate_tree(_whole(spark, 99), problem, lambda: F.col("start").cast("string"), lambda kids: F.array_join(kids, ","), partitioner=partitioner, tasks=8)
        return out.select(F.col("value").alias("leaves"))

    return run


for _kind in (granularity.SIMPLE, granularity.AUTOMATIC, granularity.CUSTOM, granularity.SERIAL):
    QUERIES[f"tree_order_{_kind}"] = _tree_query(_kind)
    ORACLE_SQL[f"tree_order_{_kind}"] = _MIDPOINT.format(end=99) + "SELECT string_agg(s::VARCHAR, ',' ORDER BY s) AS leaves FROM t WHERE s = e"


@query("WITH RECURSIVE t(n, marks) AS (SELECT 9::BIGINT, 0::BIGINT UNION ALL SELECT n - k, marks + n FROM t, (VALUES (1), (2)) v(k) WHERE n >= 2) SELECT sum(marks)::BIGINT AS marks, count(*) AS leaves FROM t WHERE n < 2")
def pre_rec_marks(spark, sf_dir):
    """`pre_rec` changes inner nodes before their children are made, which inherit the change."""
    children = lambda: F.array(*(F.struct((F.col("n") - k).alias("n"), F.col("marks").alias("marks")) for k in (1, 2)))
    problem = Problem(("n", "marks"), lambda: F.col("n") < 2, children, pre_rec=lambda df: df.withColumn("marks", F.col("marks") + F.col("n")))
    body = Body({"marks": lambda: F.col("marks"), "leaves": lambda: F.lit(1).cast("long")}, {"marks": F.sum, "leaves": F.sum})
    return evaluate(spark.createDataFrame([(9, 0)], "n long, marks long"), problem, body).value


@query("SELECT arity::INTEGER AS arity, tasks::INTEGER AS tasks, (CASE WHEN arity = 0 THEN 3 WHEN arity = 1 THEN 0 ELSE (SELECT min(l) FROM range(40) r(l) WHERE pow(arity, l) >= tasks) END)::INTEGER AS levels FROM range(5) a(arity), (VALUES (1), (2), (7), (8), (64), (100)) t(tasks)")
def task_levels(spark, sf_dir):
    return spark.createDataFrame([(a, t, levels_for_tasks(a, t)) for a in range(5) for t in (1, 2, 7, 8, 64, 100)], "arity int, tasks int, levels int")


@query("SELECT 'automatic' AS partitioner, 16::INTEGER AS tasks, 1::INTEGER AS ranks, true AS timed")
def run_info(spark, sf_dir):
    info = evaluate(_one(spark, 10), _fib(), _fib_body(), granularity.AUTOMATIC, tasks=16).info
    return spark.createDataFrame([(info.partitioner, info.tasks, info.ranks, info.seconds > 0)], "partitioner string, tasks int, ranks int, timed boolean")


# ---- behaviors ------------------------------------------------------------------------------------------------

_EVERY_RANK = _MIDPOINT.format(end=4095) + "SELECT rank::INTEGER AS rank, total, leaves FROM (SELECT sum(s)::BIGINT AS total, count(*) AS leaves FROM t WHERE s = e), range(4) r(rank)"


def _behaves(behavior: Behavior, policy: Policy = Policy(), **options) -> DataFrame:
    def run(spark, sf_dir):
        return evaluate(_whole(spark, 4095), ranges.midpoint_split(), _midpoint_body(), granularity.AUTOMATIC, behavior, policy, **options).value

    return run


for _name, _behavior in {
    "behavior_scatter": Behavior.SCATTER, "behavior_prioritize_dm": Behavior.PRIORITIZE_DM, "behavior_balance": Behavior.BALANCE, "behavior_use_cost": Behavior.USE_COST,
    "behavior_replicated_input": Behavior.REPLICATED_INPUT, "behavior_replicate_input": Behavior.REPLICATE_INPUT, "behavior_keep_input": Behavior.KEEP_INPUT | Behavior.SAFE_LOAD,
}.items():
    QUERIES[_name], ORACLE_SQL[_name] = _behaves(_behavior), _SUM


@query(_EVERY_RANK)
def behavior_replicate_output(spark, sf_dir):
    return _behaves(Behavior.REPLICATE_OUTPUT)(spark, sf_dir)


_BLOCKS = _MIDPOINT.format(end=4095) + ", top AS (SELECT s, e, ntile(4) OVER (ORDER BY s) - 1 AS rank FROM t WHERE e - s = 1023) SELECT {cols} FROM (SELECT rank::INTEGER AS rank, sum(t.s)::BIGINT AS total, count(*) AS leaves FROM t JOIN top ON t.s BETWEEN top.s AND top.e WHERE t.s = t.e GROUP BY rank)"


@query(_BLOCKS.format(cols="rank, total, leaves"))
def behavior_distributed_output(spark, sf_dir):
    """Four sub-ranges, one for each rank, whose results stay apart."""
    return _behaves(Behavior.DISTRIBUTED_OUTPUT)(spark, sf_dir)


@query(_BLOCKS.format(cols="string_agg(total::VARCHAR, ',' ORDER BY rank) AS totals, sum(total)::BIGINT AS total"))
def behavior_gather(spark, sf_dir):
    """Ranks' results in the order of ranks, and the whole."""
    out = _behaves(Behavior.GATHER)(spark, sf_dir)
    return out.select(F.array_join(F.transform("gathered", lambda x: x["total"].cast("string")), ",").alias("totals"), "total")


@query(_BLOCKS.format(cols="string_agg(total::VARCHAR, ',' ORDER BY rank) AS totals, r.place AS at") + ", (SELECT unnest(range(4))::INTEGER AS place) r GROUP BY r.place")
def behavior_all_gather(spark, sf_dir):
    out = _behaves(Behavior.GATHER | Behavior.REPLICATE_OUTPUT | Behavior.REPLICATED_INPUT)(spark, sf_dir)
    return out.select(F.array_join(F.transform("gathered", lambda x: x["total"].cast("string")), ",").alias("totals"), F.col("rank").alias("at"))


@query(_BLOCKS.format(cols="max(total) AS most, min(total) AS least, count(*) AS ranks"))
def behavior_user_post(spark, sf_dir):
    """The user's own reduction of the ranks' partial results."""
    return _behaves(Behavior.DEFAULT, distributed_post=lambda p: p.agg(F.max("total").alias("most"), F.min("total").alias("least"), F.count(F.lit(1)).alias("ranks")))(spark, sf_dir)


@query(_MIDPOINT.format(end=63) + "SELECT s AS n, -s AS v FROM t WHERE s = e")
def behavior_void_gathers_input(spark, sf_dir):
    """A body without a result gives its input back, after the user's pass over it."""
    out = evaluate(_whole(spark, 63), ranges.midpoint_split(), Body({"n": lambda: F.col("start")}, {}), gather_input_post=lambda df: df.select(F.col("start").alias("n"), (-F.col("start")).alias("v")))
    return out.input


@query("SELECT o_orderkey % 8 AS rank, i AS pos, sum(1024 * (o_orderkey % 8) + i)::BIGINT AS total FROM orders, range(4) r(i) GROUP BY ALL")
def behavior_distributed_input(spark, sf_dir):
    """Each rank has rows of its own; vectors are summed element by element within each."""
    o = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 8).alias("r"))
    flat = Problem(("r",), lambda: F.lit(True), lambda: F.array().cast("array<struct<r: bigint>>"))
    vector = {f"v{i}": (lambda i=i: 1024 * F.col("r") + i) for i in range(4)}
    out = evaluate(o, flat, Body(vector, {k: F.sum for k in vector}), behavior=Behavior.DISTRIBUTED_INPUT | Behavior.DISTRIBUTED_OUTPUT, rank=F.col("r")).value
    return out.select("rank", F.posexplode(F.array(*vector)).alias("pos", "total")).select("rank", F.col("pos").cast("long").alias("pos"), "total")


@query("SELECT p_brand AS brand, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def replicate_input(spark, sf_dir):
    """The smaller table goes to every task if its size allows."""
    part = replicated(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"))
    l = _read(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity")  # noqa: E741
    return l.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("p_brand").alias("brand")).agg(F.sum("l_quantity").alias("quantity"))


# ---- decompositions -------------------------------------------------------------------------------------------


@query(_SUM.replace("SELECT sum(s)::BIGINT AS total, count(*) AS leaves FROM t", "SELECT run, sum(s)::BIGINT AS total, count(*) AS leaves FROM t, (VALUES (1), (2), (3)) r(run)") + " GROUP BY run")
def decomposition_reuse(spark, sf_dir):
    """One opened tree serves two evaluations; after a reset it is opened anew."""
    p, out = ranges.midpoint_split(), []
    tree = Decomposition(p, _whole(spark, 4095), Policy(ranks=3), Behavior.REUSABLE_GATHER)
    for run in (1, 2, 3):
        if run == 3:
            tree.reset()
        got = evaluate(_whole(spark, 4095), p, _midpoint_body(), granularity.AUTOMATIC, Behavior.REUSABLE_GATHER, Policy(ranks=3), kept=tree).value
        out.append(got.select(F.lit(run).alias("run"), "total", "leaves"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT 4::BIGINT AS parts, 4095::BIGINT * 4096 // 2 AS total, true AS same")
def decomposition_buffered(spark, sf_dir):
    """Results are kept with the decomposition, by name."""
    tree = Decomposition(ranges.midpoint_split(), _whole(spark, 4095), buffered=True)
    make = lambda dealt: dealt.select(((F.col("start") + F.col("end")) * (F.col("end") - F.col("start") + 1) / 2).cast("long").alias("part"))
    first, again = tree.result("sums", make), tree.result("sums", make)
    return first.agg(F.count(F.lit(1)).alias("parts"), F.sum("part").alias("total"), F.lit(first is again).alias("same"))


@query("WITH RECURSIVE t(d, n) AS (SELECT 0::BIGINT, 1::BIGINT UNION ALL SELECT d + 1, 3 * n FROM t WHERE n < 10) SELECT d AS level, n AS rows FROM t")
def open_tree_levels(spark, sf_dir):
    """A tree is opened until its sub-problems suffice for ten ranks."""
    held = decompose.open_tree(_range(spark), ranges.nested_split(3), Policy(ranks=10))
    out = held[0].select(F.lit(0).cast("long").alias("level"))
    for k, f in enumerate(held[1:], 1):
        out = out.unionByName(f.select(F.lit(k).cast("long").alias("level")))
    return out.groupBy("level").agg(F.count(F.lit(1)).alias("rows"))


def _range(spark) -> DataFrame:
    return spark.createDataFrame([(0, 1000)], "start long, end long")


@query("SELECT true AS capped, 1::BIGINT AS roots")
def open_tree_stops(spark, sf_dir):
    """Opening ends at the most sub-problems for each rank, whatever the imbalance, and at once if the root is a base."""
    policy = Policy(ranks=2, max_imbalance=0.0, most_per_rank=5)
    n = decompose.leaves(decompose.open_tree(_range(spark), ranges.nested_split(3), policy, Behavior.USE_COST)).count()
    base = decompose.open_tree(spark.createDataFrame([(0, 2)], "start long, end long"), ranges.nested_split(3), policy)
    return spark.createDataFrame([(10 <= n <= 30, sum(f.count() for f in base))], "capped boolean, roots long")


@query("SELECT 5::BIGINT AS ranks, true AS balanced, 1000::DOUBLE AS cost")
def balance_tree(spark, sf_dir):
    """Opened until the ranks' costs differ by a fifth at most."""
    policy = Policy(ranks=5)
    parts = decompose.leaves(decompose.open_tree(_range(spark), ranges.nested_split(3), policy, Behavior.USE_COST))
    dealt = decompose.deal_to_ranks(parts, policy, Behavior.USE_COST).groupBy("rank").agg(F.sum("cost").alias("n"))
    return dealt.agg(F.count(F.lit(1)).alias("ranks"), ((F.max("n") - F.min("n")) / F.min("n") <= policy.max_imbalance).alias("balanced"), F.sum("n").alias("cost"))


_GREEDY = """WITH RECURSIVE i AS (SELECT n_nationkey AS k, (n_nationkey * 7 % 11 + 1)::DOUBLE AS c, sum((n_nationkey * 7 % 11 + 1)::DOUBLE) OVER () / 4 AS lim FROM nation),
s(k, rank, held) AS (SELECT -1, 0, 0::DOUBLE UNION ALL SELECT i.k, CASE WHEN held > 0 AND held + c > lim AND rank < 3 THEN rank + 1 ELSE rank END, CASE WHEN held > 0 AND held + c > lim AND rank < 3 THEN c ELSE held + c END FROM s JOIN i ON i.k = s.k + 1)
SELECT k::INTEGER AS item, rank::INTEGER AS rank FROM s WHERE k >= 0"""


@query(_GREEDY)
def balance_greedy(spark, sf_dir):
    """Ordered items go to the next rank when the limit would be passed."""
    rows = _read(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()  # a frontier's few items
    costs = [float(r[0] * 7 % 11 + 1) for r in rows]
    return spark.createDataFrame([(r[0], k) for r, k in zip(rows, balance.greedy_split(costs, 4))], "item int, rank int")


@query("SELECT 9::DOUBLE AS before, 6::DOUBLE AS after")
def balance_refine(spark, sf_dir):
    """Boundary items leave the most loaded rank: 1, 2, 3, 3 and 2, 2 in two ranks become 6 and 7 less the rest."""
    costs, ranks = [1.0, 2.0, 3.0, 3.0, 1.0, 2.0], [0, 0, 0, 0, 1, 1]
    most = lambda r: max(decompose.block_loads(costs, r, 2))
    return spark.createDataFrame([(most(ranks), most(balance.refine_split(costs, ranks, 2)))], "before double, after double")


# ---- ranges and loops -----------------------------------------------------------------------------------------


@query("SELECT s AS start, e AS \"end\", e - s AS exclusive, e - s + 1 AS inclusive, s + 5 AS shifted, ceil((e - s) / 7.0)::BIGINT AS chunk FROM (SELECT o_orderkey AS s, o_orderkey + o_custkey AS e FROM orders)")
def range_sizes(spark, sf_dir):
    s, e = F.col("start"), F.col("end")
    rows = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey")).alias("end"))
    return rows.select("start", "end", ranges.size(s, e).alias("exclusive"), ranges.size(s, e, True).alias("inclusive"), ranges.shift(s, e, 5)[0].alias("shifted"), ranges.max_chunk(s, e, 7).cast("long").alias("chunk"))


@query("SELECT chunk::BIGINT AS chunk, min(i)::BIGINT AS start, max(i)::BIGINT AS \"end\" FROM (SELECT i, ntile(7) OVER (ORDER BY i) AS chunk FROM range(3, 105) t(i)) GROUP BY chunk")
def range_chunks_inclusive(spark, sf_dir):
    return ranges.split_range(spark, 3, 104, 7, inclusive=True)


@query("SELECT proc::BIGINT AS proc, task::BIGINT AS task, min(i)::BIGINT AS start, max(i)::BIGINT AS \"end\" FROM (SELECT *, ntile(4) OVER (PARTITION BY proc ORDER BY i) AS task FROM (SELECT i, ntile(3) OVER (ORDER BY i) AS proc FROM range(0, 102) t(i))) GROUP BY ALL")
def range_chunks_two_level_inclusive(spark, sf_dir):
    return ranges.nested_ranges(spark, 0, 101, 3, 4, inclusive=True).select("proc", F.col("task").cast("long").alias("task"), "start", "end")


@query("SELECT chunk::INTEGER AS chunk, c_custkey, row_number() OVER (PARTITION BY chunk ORDER BY c_custkey) - 1 AS pos FROM (SELECT c_custkey, ntile(6) OVER (ORDER BY c_custkey) AS chunk FROM customer)")
def ranged_relative(spark, sf_dir):
    """Positions count from where a chunk starts."""
    return ranges.ranged(_read(spark, sf_dir, "customer").select("c_custkey"), 6, "c_custkey", relative=True).select("chunk", "c_custkey", "pos")


@query("SELECT c_custkey, pos - 10 AS pos FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) WHERE pos >= 10 AND pos < 30")
def slice_rows(spark, sf_dir):
    return ranges.slice_rows(ranges.with_position(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey"), 10, 30, relative=True)


@query("SELECT pos, c_acctbal * 2 AS value FROM (SELECT c_acctbal, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM customer) WHERE pos >= 5 AND pos < 25")
def fill_slice(spark, sf_dir):
    c = ranges.with_position(_read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_custkey")
    return ranges.fill(c, F.col("c_acctbal") * 2, 5, 25).select("pos", "value")


@query("WITH RECURSIVE t(s, e) AS (SELECT 0, 1000 UNION ALL SELECT s + i * ((e - s) // 3) + least(i, (e - s) % 3), s + (i + 1) * ((e - s) // 3) + least(i + 1, (e - s) % 3) FROM t, range(3) r(i) WHERE e - s >= 3) SELECT count(*) AS leaves, sum(e - s)::BIGINT AS covered FROM t WHERE e - s < 3")
def srange_limit(spark, sf_dir):
    """Ranges up to the limit are split further within tasks."""
    rows = granularity.contributions(_range(spark), ranges.nested_split(3, limit=100), T.StructType([T.StructField("n", T.LongType())]), granularity.CUSTOM)
    return rows.agg(F.count(F.lit(1)).alias("leaves"), F.sum("n").alias("covered"))


@query("SELECT i::BIGINT AS i, (i * i)::BIGINT AS y FROM range(0, 3200) t(i)")
def psfor_index(spark, sf_dir):
    return loops.psfor(spark, 0, 3200, 300, y=lambda i: i * i)


@query("SELECT sum(i)::BIGINT AS value, max(i)::BIGINT AS most, 7::BIGINT AS none FROM range(0, 3200) t(i)")
def psfor_reduce_neutral(spark, sf_dir):
    """Sums and greatest numbers over chunks; an empty range gives the neutral value."""
    value = loops.psfor_reduce(spark, 0, 3200, 100, lambda i: i, neutral=F.lit(0).cast("long"))
    most = loops.psfor_reduce(spark, 0, 3200, 100, lambda i: i, F.max).withColumnRenamed("value", "most")
    none = loops.pfor_reduce(spark, 9, 9, 4, lambda i: i, neutral=F.lit(7).cast("long")).withColumnRenamed("value", "none")
    return loops.replicate_output(loops.replicate_output(value, most), none)


@query("SELECT chunk::INTEGER AS chunk FROM (VALUES (1), (2), (4), (8), (20)) t(chunk)")
def psfor_test_chunks(spark, sf_dir):
    """The first round of the tuner for a loop: which chunk sizes it measured."""
    return loops.psfor_test(spark, 0, 100_000, rounds=1, y=lambda i: i * 2).select("chunk")


@query("SELECT 1000000::BIGINT AS best, true AS ranked, true AS tried")
def psfor_reduce_test_report(spark, sf_dir):
    """Both rounds of the tuner for a reduction: its report is ranked and begins with the best."""
    rows = loops.psfor_reduce_test(spark, 0, 100_000, lambda i: i * 2, options=tune.Options(sub=7, most=10)).collect()
    scores = [r["score"] for r in rows]
    return spark.createDataFrame([(max(scores), scores == sorted(scores, reverse=True), {1, 2, 4, 8, 20} <= {r["chunk"] for r in rows} and len(rows) <= 10)], "best long, ranked boolean, tried boolean")


@query("SELECT i::BIGINT AS i, (3 * i)::BIGINT AS y, ((i - 10) // 25)::INTEGER AS rank FROM range(10, 110) t(i)")
def dpfor_ranks(spark, sf_dir):
    """Values stay with the rank that made them."""
    return loops.dpfor(spark, 10, 110, 4, y=lambda i: i * 3)


@query("SELECT string_agg((i * 3)::VARCHAR, ',' ORDER BY i) AS ys FROM range(10, 110) t(i)")
def dpfor_gather(spark, sf_dir):
    out = loops.dpfor(spark, 10, 110, 4, Behavior.GATHER, y=lambda i: i * 3)
    return out.select(F.array_join(F.transform("values", lambda x: x["y"].cast("string")), ",").alias("ys"))


@query("SELECT rank::INTEGER AS rank, value FROM (SELECT sum(i)::BIGINT AS value FROM range(100) t(i)), range(3) r(rank)")
def dpfor_reduce_replicated(spark, sf_dir):
    return loops.dpfor_reduce(spark, 0, 100, 3, lambda i: i)


@query("SELECT (i // 25)::INTEGER AS rank, sum(i)::BIGINT AS value FROM range(100) t(i) GROUP BY 1")
def dpfor_reduce_distributed(spark, sf_dir):
    return loops.dpfor_reduce(spark, 0, 100, 4, lambda i: i, behavior=Behavior.DISTRIBUTED_OUTPUT)


@query("SELECT i::BIGINT AS i, (i + 1)::BIGINT AS y, (i // 32)::INTEGER AS rank FROM range(0, 128) t(i)")
def dpsfor_ranks(spark, sf_dir):
    return loops.dpsfor(spark, 0, 128, 32, y=lambda i: i + 1)


@query("SELECT rank::INTEGER AS rank, value FROM (SELECT max(i * 7 % 101)::BIGINT AS value FROM range(128) t(i)), range(4) r(rank)")
def dpsfor_reduce_replicated(spark, sf_dir):
    return loops.dpsfor_reduce(spark, 0, 128, 32, lambda i: i * 7 % 101, F.max)


@query("SELECT chunk::INTEGER AS chunk FROM (VALUES (1), (2), (4), (8), (20)) t(chunk)")
def dpsfor_test_chunks(spark, sf_dir):
    return loops.dpsfor_test(spark, 0, 2000, tune.Options(largest=32), rounds=1, y=lambda i: i * 2).select("chunk")


@query("SELECT chunk::INTEGER AS chunk FROM (VALUES (1), (2), (4), (8), (20)) t(chunk)")
def fold_test_chunks(spark, sf_dir):
    """The first round of the tuner for a fold: which chunk sizes it measured."""
    return evaluate_test(_whole(spark, 511), ranges.midpoint_split(), _midpoint_body(), rounds=1).select("chunk")


@query(_SUM)
def fold_ranks_and_tasks(spark, sf_dir):
    """Two ranks of four tasks each: under every rank's sub-problems as many levels are dealt out as its tasks need."""
    return evaluate(_whole(spark, 4095), ranges.midpoint_split(), _midpoint_body(), granularity.AUTOMATIC, Behavior.BALANCE, Policy(ranks=2), tasks=8).value


# ---- tuner and statistics -------------------------------------------------------------------------------------

_SCORES = "WITH s AS (SELECT chunk, {stat}(speed) AS s FROM (SELECT (l_quantity::INTEGER) AS chunk, l_extendedprice AS speed FROM lineitem) GROUP BY chunk), f AS (SELECT chunk, round(s / (SELECT max(s) FROM s) * 1000000)::BIGINT AS score FROM s) "


@query(_SCORES.format(stat="avg") + "SELECT chunk, score FROM f WHERE score >= 1000000 - 150000")
def chunk_survivors(spark, sf_dir):
    return tune.survivors(tune.scores(_runs(spark, sf_dir)), 150_000)


@query(_SCORES.format(stat="median") + "SELECT chunk, score FROM f ORDER BY score DESC, chunk LIMIT (SELECT count(*) - 1 FROM f)")
def chunk_drop_worst(spark, sf_dir):
    return tune.without_worst(tune.scores(_runs(spark, sf_dir), "median")).select("chunk", "score")


@query("SELECT level::INTEGER AS level, (CASE WHEN level < 0 THEN 90000 WHEN level >= 4 THEN 10000 ELSE 90000 - 80000 // 4 * (level + 1) END)::INTEGER AS allowed FROM range(-1, 6) t(level)")
def tolerance_schedule(spark, sf_dir):
    o = tune.PRESETS["dynamic_gradual_4"]
    return spark.createDataFrame([(k, tune.tolerance(o, k)) for k in range(-1, 6)], "level int, allowed int")


@query("SELECT 33::BIGINT AS presets, 4::BIGINT AS modes, 90000::BIGINT AS widest, 46::BIGINT AS most")
def tuner_presets(spark, sf_dir):
    o = tune.PRESETS.values()
    return spark.createDataFrame([(len(o), len({x.mode for x in o}), max(x.start_tolerance for x in o), max(x.most for x in o))], "presets long, modes long, widest long, most long")


@query("SELECT mode::INTEGER AS mode, seconds::DOUBLE AS seconds FROM (VALUES (0, round(600 / round(12 * (2 + 1 / 2.0 + 1 / 3.0 + 1 / 4.0 + (4 - 1) / 5.0)), 4)), (1, round(600 / 48.0, 4)), (2, round(600 / 84.0, 4)), (3, round(600 / 63.0, 4))) t(mode, seconds)")
def tuner_test_seconds(spark, sf_dir):
    """A test's share of 600 seconds, in each mode at its sixth setting."""
    rows = [(m, round(tune.test_seconds(tune.Options(mode=m, sub=6, seconds=600.0)), 4)) for m in range(4)]
    return spark.createDataFrame(rows, "mode int, seconds double")


@query("SELECT mode::INTEGER AS mode, 1000000::BIGINT AS best FROM range(4) t(mode)")
def tuner_modes(spark, sf_dir):
    """All modes end with a report that begins with the best."""
    rows = [(m, tune.autotune(spark, lambda c: None, 1.0, tune.Options(mode=m, sub=7 if m == 0 else 2, most=8, start_tolerance=90_000, end_tolerance=10_000)).first()["score"]) for m in range(4)]
    return spark.createDataFrame(rows, "mode int, best long")


@query("SELECT round(avg(p_size))::BIGINT AS mean, round(median(p_size))::BIGINT AS median, 0::DOUBLE AS none FROM part")
def stats_integral(spark, sf_dir):
    """Whole numbers have whole means; no numbers have zero."""
    p = _read(spark, sf_dir, "part")
    none = p.where("p_size < 0").agg(stats.harmonic_mean(F.col("p_size")).alias("none"))
    return loops.replicate_output(p.agg(stats.mean(F.col("p_size"), True).alias("mean"), stats.median(F.col("p_size"), True).alias("median")), none)


# ---- text formats ---------------------------------------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY v / w DESC, v DESC, w DESC) - 1 AS k, v AS value, w AS weight, 60 AS capacity FROM (SELECT (floor(p_retailprice)::BIGINT % 97 + 1)::INTEGER AS v, (p_size % 23 + 1)::INTEGER AS w FROM part)")
def knapsack_text(spark, sf_dir):
    """Items written as text and read back by falling value for weight."""
    items, path = _items(spark, sf_dir), scratch(spark, f"items-{uuid.uuid4().hex}")
    text.write_numbers(items, path, f"{items.count()} 60", "value", "weight", order="k")
    rows, capacity = text.knapsack(spark, path)
    return ranges.with_position(rows, F.desc(F.col("value") / F.col("weight")), F.desc("value"), F.desc("weight")).select(F.col("pos").alias("k"), "value", "weight", F.lit(capacity).alias("capacity"))


@query("SELECT n_nationkey // 5 + 1 AS i, n_nationkey + 6 AS j, 30 AS n FROM nation WHERE n_nationkey < 24")
def digraph_text(spark, sf_dir):
    edges = _read(spark, sf_dir, "nation").where("n_nationkey < 24").select("n_nationkey", (F.col("n_nationkey") + 6).alias("j"), (F.floor(F.col("n_nationkey") / 5) + 1).alias("i"))
    path = scratch(spark, f"edges-{uuid.uuid4().hex}")
    text.write_numbers(edges, path, "30 24", "j", "i", order="n_nationkey")
    rows, n = text.digraph(spark, path)
    return rows.withColumn("n", F.lit(n))


@query("SELECT cell::INTEGER AS cell, alternatives::INTEGER AS alternatives, l::INTEGER AS \"left\", ab::INTEGER AS above, after::INTEGER AS after, 216::INTEGER AS area FROM (VALUES (1, 2, 0, -1, 2), (2, 1, 1, -1, 0)) t(cell, alternatives, l, ab, after)")
def floorplan_text(spark, sf_dir):
    lines = spark.createDataFrame([(0, "2\n3 10\n6 5\n0 -1\n2"), (1, "1\n2 12\n1 -1\n0"), (2, "216")], "at int, line string")
    path = scratch(spark, f"plan-{uuid.uuid4().hex}")
    text.write_numbers(lines, path, "2", "line", order="at")
    cells, area = text.floorplan(spark, path)
    return spark.createDataFrame([(k + 1, len(c[0]), *c[1:], area) for k, c in enumerate(cells)], "cell int, alternatives int, left int, above int, after int, area int")


@query("SELECT vec_id + copy * (SELECT count(*) FROM embeddings) AS id, (1 + label)::DOUBLE AS mass, true AS near FROM embeddings, range(2) r(copy)")
def bodies_text(spark, sf_dir):
    """Bodies written, read back twice over, the copies moved a little."""
    b = _bodies(spark, sf_dir)
    for a in "xyz":
        b = b.withColumn(f"v{a}", F.lit(0.0))
    b = ranges.with_position(b, "id")  # the text has no ids: they go by its order
    path, names = scratch(spark, f"bodies-{uuid.uuid4().hex}"), ("mass", "px", "py", "pz", "vx", "vy", "vz")
    text.write_numbers(b, path, f"{b.count()} 1 0.025 0.05 0.5", *names, order="pos")
    rows, info = text.bodies(spark, path, copies=2, jitter=0.01)
    n = int(info["n"]) // 2
    own = b.select(F.col("pos").alias("of"), F.col("id").alias("own"), F.col("px").alias("x"))
    placed = rows.withColumn("of", F.col("id") % n).join(own, "of")
    return placed.select((F.col("own") + F.col("id") - F.col("of")).alias("id"), "mass", (F.abs(F.col("px") - F.col("x")) <= 0.01).alias("near"))


@query("SELECT vec_id AS pos, embedding[1]::DOUBLE AS px FROM embeddings")
def positions_text(spark, sf_dir):
    """Positions written with four digits; read back they are those of the bodies, to that many."""
    b, path = _bodies(spark, sf_dir), scratch(spark, f"positions-{uuid.uuid4().hex}")
    text.write_positions(b, path)
    lines = spark.read.text(path).select(F.split("value", " ")[0].cast("double").alias("near"))
    found = lines.groupBy(F.round("near", 9).alias("near")).agg(F.count(F.lit(1)).alias("n"))
    at = b.select(F.col("id").alias("pos"), "px", F.round(F.format_string("%.4e", F.col("px")).cast("double"), 9).alias("near"))
    return at.join(found, "near").select("pos", "px")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def sort_descending_top(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return workloads.sort_descending(o, "o_totalprice", "o_orderkey").limit(20)


@query("WITH b AS (SELECT vec_id AS id, (1 + label)::DOUBLE AS mass, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings), p AS (SELECT a.id, a.px, b.mass * pow(pow(b.px - a.px, 2) + pow(b.py - a.py, 2) + pow(b.pz - a.pz, 2) + 0.05 * 0.05, -1.5) * (b.px - a.px) AS f FROM b a, b) SELECT id, round(any_value(px) + 0.001 * 0.001 * sum(f), 6) AS px, round(0.001 * sum(f), 4) AS vx FROM p GROUP BY id")
def barnes_hut_step(spark, sf_dir):
    """A leapfrog step of bodies at rest, all cells opened."""
    b = _bodies(spark, sf_dir)
    for a in "xyz":
        b = b.withColumn(f"v{a}", F.lit(0.0))
    out = workloads.simulate(b, 1, 0.001, tol=1e-9)
    return out.select("id", F.round("px", 6).alias("px"), F.round("vx", 4).alias("vx"))


NAMES = set(QUERIES) - _BEFORE
