"""Behaviors, granularity, decompositions, the tuner and workloads beyond what the queries show."""

import itertools

import pytest
from pyspark.sql import functions as F

from coppice.functions import random as rnd
from coppice.operators import balance, loops, ranges, workloads
from coppice.operators.problem import Body, Problem, Serial
from coppice.plans import decompose, frontier, granularity, lineage, tune
from coppice.plans.behavior import Behavior, all_gathers, resolve
from coppice.plans.decompose import Decomposition, Policy
from coppice.plans.evaluate import evaluate, evaluate_tree, replicated
from coppice.sources import text


def test_implied_and_contradicting_behaviors():
    B = Behavior
    assert resolve(B.REPLICATE_INPUT) & B.REPLICATED_INPUT and resolve(B.REUSABLE_GATHER) & B.GATHER and resolve(B.USE_COST) & B.BALANCE
    assert resolve(B.DEFAULT, returns=False) == B.GATHER_INPUT and resolve(B.DISTRIBUTED_OUTPUT, returns=False) == B.DISTRIBUTED_OUTPUT
    for wrong in (B.REPLICATE_INPUT | B.DISTRIBUTED_INPUT, B.PRIORITIZE_DM | B.SCATTER, B.DISTRIBUTED_OUTPUT | B.REPLICATE_OUTPUT):
        with pytest.raises(ValueError):
            resolve(wrong, arity=2)
    with pytest.raises(ValueError):
        resolve(B.PRIORITIZE_DM)
    both = B.GATHER | B.REPLICATE_OUTPUT | B.REPLICATED_INPUT
    assert all_gathers(both) and not all_gathers(both | B.GATHER_INPUT) and not all_gathers(B.GATHER)


def midpoint_body():
    return Body({"total": lambda: F.col("start"), "leaves": lambda: F.lit(1).cast("long")}, {"total": F.sum, "leaves": F.sum})


def whole(spark, end):
    return spark.createDataFrame([(0, end)], "start long, end long")


@pytest.mark.parametrize("partitioner", ["simple", "automatic", "custom", "serial"])
def test_partitioners_agree_also_without_roots(spark, partitioner):
    p = ranges.midpoint_split()
    assert tuple(evaluate(whole(spark, 200), p, midpoint_body(), partitioner).value.first()) == (200 * 201 // 2, 201)
    assert tuple(evaluate(whole(spark, 200).limit(0), p, midpoint_body(), partitioner).value.first()) == (None, None)
    assert frontier.fold(whole(spark, 9).limit(0), p, midpoint_body()).first().total is None


def test_pre_is_applied_once_under_every_partitioner(spark):
    """`pre` adds one to each node it sees, so a second pass would show."""
    kids = lambda: F.array(*(F.struct((F.col("n") - 1).alias("n"), F.col("seen").alias("seen")) for _ in range(2)))
    serial = Serial(lambda x: x["n"] == 0, lambda x: [{"n": x["n"] - 1, "seen": x["seen"]}] * 2, lambda x: {"seen": x["seen"], "inner": 0}, lambda x: {"seen": x["seen"], "inner": 1}, pre=lambda x: {**x, "seen": x["seen"] + 1})
    problem = Problem(("n", "seen"), lambda: F.col("n") == 0, kids, pre=lambda df: df.withColumn("seen", F.col("seen") + 1), arity=2, do_parallel=lambda: F.col("n") > 2, serial=serial)
    one = lambda x: lambda: F.lit(x).cast("long")
    body = Body({"seen": lambda: F.col("seen"), "inner": one(0)}, {"seen": F.sum, "inner": F.sum}, {"seen": lambda: F.col("seen"), "inner": one(1)})
    roots = spark.createDataFrame([(5, 0)], "n long, seen long")
    want = (sum((d + 1) * 2**d for d in range(6)), 31)
    for partitioner, behavior in itertools.product(("simple", "automatic", "custom", "serial"), (Behavior.DEFAULT, Behavior.BALANCE)):
        assert tuple(evaluate(roots, problem, body, partitioner, behavior, tasks=4).value.first()) == want, (partitioner, behavior)


def test_gathered_input_and_ranks(spark):
    p = ranges.midpoint_split()
    out = evaluate(whole(spark, 63), p, midpoint_body(), "automatic", Behavior.GATHER_INPUT | Behavior.SCATTER, Policy(ranks=3))
    assert sorted(r.start for r in out.input.collect()) == list(range(64)) and out.info.ranks == 3 and out.value.first().leaves == 64
    # contiguous ranks
    spans = [(r["a"], r["b"]) for r in out.input.groupBy("rank").agg(F.min("start").alias("a"), F.max("start").alias("b")).orderBy("a").collect()]
    assert all(b < c for (_, b), (c, _) in zip(spans, spans[1:])) and len(spans) == 3


def test_walks_stop_at_their_budget():
    serial = ranges.midpoint_split().serial
    done, left = granularity.walk({"start": 0, "end": 999}, serial, 100)
    while left:
        (node, _), *left = left
        more, rest = granularity.walk(node, serial, 100)
        done, left = done + more, left + rest
    assert sorted(v["total"] for _, v, _ in done) == list(range(1000))
    assert granularity.evaluate_serially({"start": 3, "end": 9}, serial) == {"total": 42, "leaves": 7}


def test_open_nodes_have_no_values_yet(spark):
    """Contributions that can't be null leave rows of open nodes without them."""
    rows = evaluate(whole(spark, 500), ranges.midpoint_split(), midpoint_body(), "serial")
    values = spark.range(1).select(F.lit(1).cast("long").alias("total"), F.lit(1).cast("long").alias("leaves")).schema
    few = granularity.contributions(whole(spark, 500), ranges.midpoint_split(), values, "serial", budget=50)
    assert tuple(few.agg(F.sum("total"), F.sum("leaves")).first()) == tuple(rows.value.first()) == (500 * 501 // 2, 501)


def test_tree_of_a_table(spark):
    rows = [(1, None, 0, 1), (2, 1, 1, 10), (3, 1, 1, 20), (4, 3, 2, 300), (5, None, 0, 7)]
    nodes = spark.createDataFrame(rows, "node long, up long, depth int, v long")
    got = dict(tuple(r) for r in frontier.reduce_table(nodes, {"v": F.sum}).collect())
    assert got == {1: 331, 2: 10, 3: 320, 4: 300, 5: 7}
    assert frontier.reduce_table(nodes.limit(0), {"v": F.sum}).collect() == []
    empty = evaluate_tree(whole(spark, 3).limit(0), ranges.midpoint_split(), lambda: F.col("start"), lambda kids: F.array_max(kids))
    assert empty.collect() == []


def test_decompositions(spark):
    p = ranges.midpoint_split()
    tree = Decomposition(p, whole(spark, 1023), Policy(ranks=4), buffered=True)
    assert tree.levels() is tree.levels() and tree.dealt() is tree.dealt()
    kept = tree.result("n", lambda d: d.groupBy("rank").count())
    assert tree.result("n", lambda d: None) is kept and {r["count"] for r in kept.collect()} == {1}
    tree.reset()
    assert tree._held == [] and tree._dealt is None and tree._results == {}
    by_cost = Decomposition(ranges.nested_split(3), spark.createDataFrame([(0, 10_000)], "start long, end long"), Policy(ranks=5), Behavior.USE_COST)
    loads = [r["s"] for r in by_cost.dealt().groupBy("rank").agg(F.sum("cost").alias("s")).collect()]
    assert len(loads) == 5 and (max(loads) - min(loads)) / min(loads) <= 0.2
    many = spark.range(1000).select(F.array(F.col("id").cast("int")).alias("path"), F.lit(1.0).alias("cost"))
    small, decompose.SMALL = decompose.SMALL, 10
    try:
        for behavior in (Behavior.DEFAULT, Behavior.USE_COST):
            dealt = decompose.deal_to_ranks(many, Policy(ranks=4), behavior)
            assert [r["count"] for r in dealt.groupBy("rank").count().orderBy("rank").collect()] == [250] * 4
    finally:
        decompose.SMALL = small


def test_cost_split_needs_no_single_partition(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("c"))
    out = balance.by_cost(df, F.col("c"), "id", parts=4)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    costs, at, want = [i % 7 for i in range(1000)], 0, {}
    for i, c in enumerate(costs):
        want[i] = min(4, int(at * 4 / sum(costs)) + 1)
        at += c
    assert {r.id: r["rank"] for r in out.collect()} == want
    assert balance.by_cost(df.limit(0), F.col("c"), "id", parts=4).collect() == []


def test_refinement_lowers_the_highest_load():
    costs, start = [4.0, 1.0, 1.0, 1.0, 1.0, 4.0, 2.0], [0, 0, 0, 0, 0, 1, 2]
    most = lambda r: max(decompose.block_loads(costs, r, 3))
    best = min(max(sum(costs[:a]), sum(costs[a:b]), sum(costs[b:])) for a, b in itertools.combinations(range(1, 7), 2))
    assert most(start) == 8 and most(balance.refine_split(costs, start, 3)) <= 7 and best <= 6
    assert balance.greedy_split([], 3) == [] and balance.greedy_split([9.0], 3) == [0]


def test_loops(spark):
    one = spark.range(3)
    assert [tuple(r) for r in loops.replicate_output(one, spark.createDataFrame([], "v int")).collect()] == [(0, None), (1, None), (2, None)]
    assert loops.replicate_output(one, spark.createDataFrame([(5,)], "v int")).agg(F.sum("v")).first()[0] == 15
    empty = loops.reduce_rows(one.limit(0), 3, {"n": (F.lit(1), F.sum)}, "id", neutral={"n": F.lit(0)})
    assert empty.first().n == 0
    parts = loops.distributed_post(spark.range(0, 100, 1, 4), {"n": F.count(F.lit(1))}, lambda p: p.agg(F.count("n").alias("ranks"), F.sum("n").alias("n"))).first()
    assert tuple(parts) == (4, 100)
    assert loops.psfor(spark, 0, 1000, 100, y=lambda i: i).rdd.getNumPartitions() == 10
    tuned = loops.psfor_test(spark, 0, 5000, tune.Options(most=6, largest=64, sub=7), rounds=2, y=lambda i: i).collect()
    assert len(tuned) <= 6 and tuned[0].score == tune.MILLION


def test_broadcasts_are_bounded(spark):
    small = replicated(spark.range(10).toDF("k"))
    big = replicated(spark.range(10).toDF("k"), most=8)
    plan = lambda df: spark.range(5).toDF("k").join(df, "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan(small) and "strategy=broadcast" not in plan(big)


def test_random_numbers_in_bulk(spark):
    many = rnd.lcg_many(5, rnd.lcg_powers(1000))
    x = 5
    for k in range(1000):
        x = rnd.lcg(x)
        assert x == many[k]
    row = spark.range(1).select(rnd.sha_root(7).alias("r"), rnd.sha_child(rnd.sha_root(7), F.lit(3)).alias("c"), rnd.sha_uniform(rnd.sha_root(7)).alias("u")).first()
    assert (bytes(row.r), bytes(row.c), row.u) == (rnd.root(7), rnd.child(rnd.root(7), 3), rnd.uniform(rnd.root(7)))


def test_gaussian_pairs_of_few_pairs(spark):
    row = workloads.gaussian_pairs(spark, 10).first()  # fewer than a batch
    n = 0
    draws = rnd.lcg_many(271828183, rnd.lcg_powers(2048)).reshape(-1, 2)
    n = int((((2 * draws / rnd.MODULUS - 1) ** 2).sum(axis=1) <= 1).sum())
    assert sum(row[f"q{i}"] for i in range(10)) == n <= 1024


def test_unbalanced_trees(spark):
    p = workloads.UtsParams.parse("-t 1 -a 3 -d 5 -b 4 -r 19")
    got = {tuple(workloads.unbalanced_tree(spark, p, how, budget).first()) for how, budget in (("serial", 500), ("automatic", 100_000))}
    assert got == {(3987, 3232, 5)}
    with pytest.raises(ValueError):
        workloads.UtsParams.parse("-z 1")
    lone = workloads.UtsParams(kind=workloads.BALANCED, depth=0)
    assert tuple(workloads.unbalanced_tree(spark, lone).first()) == (1, 1, 0)


def test_floorplan(spark, tmp_path):
    (tmp_path / "plan").write_text("3\n\n2\n3 2\n2 3\n0 -1\n2\n\n2\n2 2\n4 1\n1 -1\n3\n\n1\n2 4\n-1 1\n0\n\n20\n")
    cells, area = text.floorplan(spark, str(tmp_path / "plan"))
    assert area == 20 and cells == [([(3, 2), (2, 3)], 0, -1, 2), ([(2, 2), (4, 1)], 1, -1, 3), ([(2, 4)], -1, 1, 0)]
    best, todo = None, [(1, {})]
    while todo:  # every placement
        at, placed = todo.pop()
        for p in workloads.placements(cells, placed, at):
            if cells[at - 1][3]:
                todo.append((cells[at - 1][3], p))
            else:
                best = min(best or 10**9, workloads.footprint(p))
    assert workloads.floorplan(spark, cells).first().area == workloads.floorplan(spark, cells, budget=3).first().area == best


def test_knapsack_of_many_items(spark):
    import random

    r = random.Random(1)
    items = [(k, r.randint(1, 50), r.randint(1, 30)) for k in range(300)]
    best = [0] * 101
    for _, v, w in items:
        for c in range(100, w - 1, -1):
            best[c] = max(best[c], best[c - w] + v)
    assert workloads.knapsack(spark.createDataFrame(items, "k int, value int, weight int"), 100).first().best == best[100]
    assert workloads.knapsack(spark.createDataFrame([], "k int, value int, weight int"), 5).first().best == 0


def test_a_simulation_keeps_its_momentum(spark):
    rows = [(0, 1.0, 0.0, 0.0, 0.0, 0.0, 0.1, 0.0), (1, 2.0, 1.0, 0.0, 0.0, 0.0, -0.05, 0.0), (2, 0.5, 0.0, 2.0, 1.0, 0.0, 0.0, 0.0)]
    b = spark.createDataFrame(rows, "id long, mass double, px double, py double, pz double, vx double, vy double, vz double")
    out = workloads.simulate(b, 3, 0.01, tol=1e-9).collect()
    for v in ("vx", "vy", "vz"):
        assert abs(sum(r.mass * r[v] for r in out) - sum(r.mass * r[v] for r in b.collect())) < 1e-9
    assert out != b.collect() and workloads.simulate(b, 0, 0.01) is b


def test_tuner_settings():
    assert len(tune.PRESETS) == 33 and tune.PRESETS["fixed_drop_worst_3"].sub == 8 and tune.PRESETS["auto_fixed_gradual_1"].end_tolerance == 10_000
    assert [tune.test_seconds(tune.Options(sub=s)) for s in (0, 3, 5, 7)] == [4.0, 2.0, 1.5, 1.0] and tune.test_seconds(tune.Options(mode=3)) == 2.0


def test_settled_files(spark):
    mark = lineage.written()
    a = lineage.cut(spark.range(5))
    b = lineage.settle(a.where("id > 1"), mark)
    assert lineage.written() == mark + 1 and b.count() == 3
    with pytest.raises(Exception):
        spark.read.parquet(a.inputFiles()[0]).count()
