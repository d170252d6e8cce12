"""Queries of the divide-and-conquer operators, by name, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions import random, stats
from coppice.operators import balance, loops, ranges, workloads
from coppice.operators.problem import Body, Problem
from coppice.plans import frontier, granularity, tune
from coppice.plans.behavior import Behavior
from coppice.plans.evaluate import evaluate

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _whole(spark, end: int) -> DataFrame:
    return spark.createDataFrame([(0, end)], "start long, end long")


def _midpoint_body() -> Body:
    return Body({"total": lambda: F.col("start"), "leaves": lambda: F.lit(1).cast("long")}, {"total": F.sum, "leaves": F.sum})


@query("SELECT sum(l_quantity) AS total, min(l_quantity) AS least, max(l_quantity) AS most, count(*) AS n FROM lineitem")
def pfor_reduce_sum(spark, sf_dir):
    """Seven contiguous chunks of the rows, reduced within each and then over all."""
    q = F.col("l_quantity")
    return loops.reduce_rows(_read(spark, sf_dir, "lineitem"), 7, {"total": (q, F.sum), "least": (q, F.min), "most": (q, F.max), "n": (F.lit(1).cast("long"), F.sum)}, "l_orderkey", "l_linenumber")


@query("SELECT sum(i * i) AS value FROM range(10000) t(i)")
def pfor_reduce_index(spark, sf_dir):
    return loops.pfor_reduce(spark, 0, 10000, 16, lambda i: i * i).select(F.col("value").cast("decimal(38,0)").alias("value"))


@query("SELECT i::BIGINT AS i, (2 * i + 1)::BIGINT AS y FROM range(5, 1000) t(i)")
def pfor_index(spark, sf_dir):
    return loops.pfor(spark, 5, 1000, 7, y=lambda i: i * 2 + 1)


@query("SELECT chunk::INTEGER AS chunk, count(*) AS n, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT o_orderkey, ntile(7) OVER (ORDER BY o_orderkey) AS chunk FROM orders) GROUP BY chunk")
def range_chunks_exclusive(spark, sf_dir):
    placed = balance.block_distribution(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", parts=7)
    return placed.groupBy(F.col("rank").alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))


@query("SELECT proc::INTEGER AS proc, task::INTEGER AS task, count(*) AS n, sum(o_orderkey)::BIGINT AS total FROM (SELECT *, ntile(5) OVER (PARTITION BY proc ORDER BY o_orderkey) AS task FROM (SELECT o_orderkey, ntile(3) OVER (ORDER BY o_orderkey) AS proc FROM orders)) GROUP BY ALL")
def range_chunks_two_level(spark, sf_dir):
    placed = balance.block_distribution(_read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", parts=3)
    blocks = placed.groupBy("rank").agg(F.min("pos").alias("start"), F.count(F.lit(1)).alias("size"))
    out = placed.join(F.broadcast(blocks), "rank").withColumn("task", ranges.chunk_of(F.col("pos") - F.col("start"), F.col("size"), 5))
    return out.groupBy(F.col("rank").alias("proc"), "task").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("total"))


@query("WITH RECURSIVE t(s, e) AS (SELECT 0, 1000 UNION ALL SELECT s + i * ((e - s) // 3) + least(i, (e - s) % 3), s + (i + 1) * ((e - s) // 3) + least(i + 1, (e - s) % 3) FROM t, range(3) r(i) WHERE e - s >= 3) SELECT s::BIGINT AS start, e::BIGINT AS \"end\" FROM t WHERE e - s < 3")
def srange_leaves(spark, sf_dir):
    root = spark.createDataFrame([(0, 1000)], "start long, end long")
    rows = granularity.contributions(root, ranges.nested_split(3), T.StructType([T.StructField("n", T.LongType())]))
    return rows.select("start", "end")


_MIDPOINT = "WITH RECURSIVE t(s, e) AS (SELECT 0::BIGINT, {end}::BIGINT UNION ALL SELECT CASE WHEN side = 0 THEN s ELSE (s + e) // 2 + 1 END, CASE WHEN side = 0 THEN (s + e) // 2 ELSE e END FROM t, (VALUES (0), (1)) v(side) WHERE s < e) "


@query(_MIDPOINT.format(end=1023) + "SELECT sum(s)::BIGINT AS total, count(*) AS leaves FROM t WHERE s = e")
def range_midpoint_sum(spark, sf_dir):
    """Sub-ranges end within tasks."""
    out = evaluate(_whole(spark, 1023), ranges.midpoint_split(), _midpoint_body(), "automatic").value
    return out.select("total", "leaves")


@query("SELECT l_orderkey, l_linenumber, l_quantity + 2 * l_extendedprice AS v FROM lineitem")
def pfor_map(spark, sf_dir):
    return loops.map_rows(_read(spark, sf_dir, "lineitem"), v=F.col("l_quantity") + 2 * F.col("l_extendedprice")).select("l_orderkey", "l_linenumber", "v")


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, round(max(o_totalprice), 4) AS most FROM orders")
def reduce_struct(spark, sf_dir):
    """A flat fold of a problem whose sub-problems are all base cases."""
    flat = Problem(("o_custkey", "o_totalprice"), lambda: F.lit(True), lambda: F.array().cast("array<struct<o_custkey: bigint, o_totalprice: double>>"))
    body = Body({"n": lambda: F.lit(1).cast("long"), "customers": lambda: F.col("o_custkey"), "most": lambda: F.col("o_totalprice")}, {"n": F.sum, "customers": F.count_distinct, "most": F.max})
    return evaluate(_read(spark, sf_dir, "orders"), flat, body).value.withColumn("most", F.round("most", 4))


@query("SELECT label, (i - 1)::INTEGER AS pos, round(sum(x::DOUBLE), 4) AS total FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def reduce_vector(spark, sf_dir):
    return loops.reduce_vectors(_read(spark, sf_dir, "embeddings"), "embedding", "label").withColumn("total", F.round("total", 4))


_POINT = "SELECT vec_id AS id, (1 + label)::DOUBLE AS mass, embedding[1]::DOUBLE AS px, embedding[2]::DOUBLE AS py, embedding[3]::DOUBLE AS pz FROM embeddings"


def _bodies(spark, sf_dir) -> DataFrame:
    axes = [F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate(("px", "py", "pz"))]
    return _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") + 1).cast("double").alias("mass"), *axes)


@query(f"SELECT min(px) AS min_px, max(px) AS max_px, min(py) AS min_py, max(py) AS max_py, min(pz) AS min_pz, max(pz) AS max_pz FROM ({_POINT})")
def bbox_minmax(spark, sf_dir):
    return workloads.bounding_box(_bodies(spark, sf_dir), "px", "py", "pz")


@query(f"WITH b AS ({_POINT}), l AS (SELECT min(px) AS x0, min(py) AS y0, min(pz) AS z0, greatest(max(px) - min(px), max(py) - min(py), max(pz) - min(pz), 1e-12) * (1 + 1e-9) AS side FROM b), o AS (SELECT mass, px, py, pz, ((floor((px - x0) / side * 2)::BIGINT % 2) * 4 + (floor((py - y0) / side * 2)::BIGINT % 2) * 2 + floor((pz - z0) / side * 2)::BIGINT % 2)::VARCHAR AS path FROM b, l) SELECT path, round(sum(mass), 4) AS mass, round(sum(mass * px) / sum(mass), 6) AS px, round(sum(mass * py) / sum(mass), 6) AS py, round(sum(mass * pz) / sum(mass), 6) AS pz, count(*) AS n FROM o GROUP BY path")
def center_of_mass(spark, sf_dir):
    cells = workloads.octants(_bodies(spark, sf_dir), 1).where("path <> ''")
    return cells.select("path", F.round("mass", 4).alias("mass"), *(F.round(a, 6).alias(a) for a in ("px", "py", "pz")), "n")


@query()
def barnes_hut_forces(spark, sf_dir):
    """By the opening test; held against a plain octree in the tests."""
    return workloads.accelerations(_bodies(spark, sf_dir))


@query("WITH RECURSIVE f(k, a, b) AS (SELECT 0, 0::BIGINT, 1::BIGINT UNION ALL SELECT k + 1, b, a + b FROM f WHERE k < 46) SELECT a AS fib FROM f WHERE k = 46")
def fib_tree(spark, sf_dir):
    return workloads.fibonacci(spark, 46)


_QUEENS = "WITH RECURSIVE q(b) AS (SELECT []::INTEGER[] UNION ALL SELECT list_append(b, i::INTEGER) FROM q, range({n}) r(i) WHERE len(b) < {n} AND NOT list_bool_or(list_append(list_transform(b, lambda v, j: v = i OR abs(v - i) = len(b) - j + 1), false))) "


@query(_QUEENS.format(n=8) + "SELECT count(*) FILTER (len(b) = 8) AS solutions, count(*) AS nodes FROM q")
def nqueens_8(spark, sf_dir):
    return workloads.queens(spark, 8)


@query(_QUEENS.format(n=6) + "SELECT list_aggregate(b, 'string_agg', ',') AS board FROM q WHERE len(b) = 6")
def nqueens_6_boards(spark, sf_dir):
    return workloads.queen_boards(spark, 6)


@query("WITH RECURSIVE t(k, level) AS (SELECT 1::BIGINT, 1 UNION ALL SELECT 2 * k + c, level + 1 FROM t, (VALUES (0), (1)) v(c) WHERE level < 11) SELECT count(*) AS total FROM t")
def tree_add(spark, sf_dir):
    return workloads.tree_add(spark, 11)


@query("WITH RECURSIVE t(k, node, v) AS (SELECT o_orderkey + 1, o_orderkey + 1, o_totalprice FROM orders UNION ALL SELECT k, node // 2, v FROM t WHERE node > 1) SELECT node AS node, round(sum(v), 2) AS total, count(*) AS n FROM t WHERE node < 64 GROUP BY node")
def tree_add_heap(spark, sf_dir):
    """Each order at its place in a heap, the sums going up level by level."""
    o = _read(spark, sf_dir, "orders").select((F.col("o_orderkey") + 1).alias("node"), F.col("o_totalprice").cast("decimal(38,4)").alias("total"), F.lit(1).cast("long").alias("n"))
    depth = (F.length(F.bin("node")) - 1).cast("int")
    out = frontier.reduce_table(o.withColumn("up", F.when(F.col("node") > 1, F.shiftright("node", 1))).withColumn("depth", depth), {"total": F.sum, "n": F.sum})
    return out.where("node < 64").select("node", F.round(F.col("total").cast("double"), 2).alias("total"), "n")


@query("SELECT r_name AS region, n_name AS nation, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def hierarchy_rollup(spark, sf_dir):
    """World, regions, nations and customers as one tree; the customers' level is reduced before the tree is cut."""
    c, n, r = (_read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    by = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("c_acctbal").cast("decimal(38,4)")).alias("total"))
    none = [F.lit(0).cast("long").alias("n"), F.lit(None).cast("decimal(38,4)").alias("total")]
    nations = n.join(by, n["n_nationkey"] == by["c_nationkey"], "left")
    rows = [
        spark.range(1).select(F.lit("world").alias("node"), F.lit(None).cast("string").alias("up"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"), *none),
        r.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.lit("world").alias("up"), F.lit(1).alias("depth"), F.col("r_name").alias("name"), *none),
        nations.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.concat(F.lit("r"), "n_regionkey").alias("up"), F.lit(2).alias("depth"), F.col("n_name").alias("name"), F.coalesce(by["n"], F.lit(0)).alias("n"), "total"),
    ]
    tree = rows[0].unionByName(rows[1]).unionByName(rows[2])
    sums = frontier.reduce_table(tree, {"n": F.sum, "total": F.sum}).where("n > 0")
    names = tree.select("node", "up", "depth", "name").alias("t")
    above = tree.select(F.col("node").alias("up_node"), F.col("name").alias("up_name"))
    out = sums.join(names, "node").join(above, F.col("up") == F.col("up_node"), "left")
    region = F.when(F.col("depth") == 1, F.col("name")).when(F.col("depth") == 2, F.col("up_name"))
    return out.select(region.alias("region"), F.when(F.col("depth") == 2, F.col("name")).alias("nation"), "n", F.round(F.col("total").cast("double"), 2).alias("total"))


@query("WITH RECURSIVE i AS (SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS k, (10 + 7 * r_regionkey % 11)::BIGINT AS v, (3 + 5 * r_regionkey % 7)::BIGINT AS w FROM region), s AS (SELECT unnest(range(32)) AS mask), t AS (SELECT mask, sum(v) AS v, sum(w) AS w FROM s, i WHERE (mask >> k) & 1 = 1 GROUP BY mask) SELECT max(v)::BIGINT AS best FROM t WHERE w <= 15")
def knapsack_items(spark, sf_dir):
    """All subsets of five items, as the SQL has them; `knapsack_part` takes all of a table's."""
    r = _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), (10 + 7 * F.col("r_regionkey") % 11).alias("value"), (3 + 5 * F.col("r_regionkey") % 7).alias("weight"))
    return workloads.knapsack(r, 15)


def _items(spark, sf_dir) -> DataFrame:
    p = _read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("k"), (F.floor("p_retailprice") % 97 + 1).cast("long").alias("value"), (F.col("p_size") % 23 + 1).cast("long").alias("weight"))


# States (weight, best value) as a list that each item in turn extends; lists are 1-based, weights are not.
_KNAPSACK = "WITH RECURSIVE i AS (SELECT row_number() OVER (ORDER BY p_partkey) AS k, (floor(p_retailprice)::BIGINT % 97 + 1) AS v, (p_size % 23 + 1)::BIGINT AS w FROM part), s(k, best) AS (SELECT 0::BIGINT, list_concat([0::BIGINT], list_transform(range(60), lambda x: -1000000000000::BIGINT)) UNION ALL SELECT s.k + 1, list_transform(range(1, 62), lambda x: greatest(s.best[x], CASE WHEN x - i.w >= 1 THEN s.best[x - i.w] + i.v ELSE -1000000000000 END)) FROM s JOIN i ON i.k = s.k + 1) SELECT list_max(best)::BIGINT AS best FROM s ORDER BY k DESC LIMIT 1"


@query(_KNAPSACK)
def knapsack_part(spark, sf_dir):
    return workloads.knapsack(_items(spark, sf_dir), 60)


def _pairs(spark, n: int) -> DataFrame:
    return spark.createDataFrame([(i, i + 1) for i in range(1, n, 2)], "i int, j int")


def _orders_sql(n: int) -> str:
    """Permutations built node by node."""
    edges = ", ".join(f"({i}, {i + 1})" for i in range(1, n, 2))
    return (
        f"WITH RECURSIVE e(i, j) AS (VALUES {edges}), need AS (SELECT r.n, coalesce(list(e.i) FILTER (e.i IS NOT NULL), []) AS before FROM range(1, {n + 1}) r(n) LEFT JOIN e ON e.j = r.n GROUP BY r.n), "
        f"s(placed) AS (SELECT []::BIGINT[] UNION ALL SELECT list_append(placed, need.n) FROM s, need WHERE NOT list_contains(placed, need.n) AND list_has_all(placed, before)) SELECT count(*) AS orders FROM s WHERE len(placed) = {n}"
    )


@query(_orders_sql(8))
def topsorts_count(spark, sf_dir):
    """Orders of eight nodes in four independent pairs."""
    return workloads.topological_orders(_pairs(spark, 8), 8)


@query(_orders_sql(6))
def topsorts_search(spark, sf_dir):
    return workloads.order_search(_pairs(spark, 6), 6)


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) - 1 AS pos FROM orders")
def quicksort_desc(spark, sf_dir):
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return ranges.with_position(o, F.desc("o_totalprice"), F.desc("o_orderkey"))


@query("WITH m AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings) SELECT a.i::INTEGER AS i, b.i::INTEGER AS j, round(sum(a.x * b.x), 3) AS v FROM m a JOIN m b USING (vec_id) GROUP BY ALL")
def matmul_embeddings(spark, sf_dir):
    """The Gram matrix of the embeddings' columns: each row's outer product, summed; its size doesn't grow."""
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id"), F.posexplode("embedding").alias("k", "x"))
    m = e.select(F.col("vec_id").alias("i"), F.col("k").alias("j"), F.col("x").cast("double").alias("v"))
    t = m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return workloads.matrix_product(t, m).withColumn("v", F.round("v", 3))


@query("WITH a AS (SELECT i, j, ((i * 7 + j * 3) % 11 - 5)::DOUBLE AS v, ((i * 5 + j) % 13 - 6)::DOUBLE AS w FROM range(16) x(i), range(16) y(j)) SELECT a.i AS i, b.j AS j, sum(a.v * b.w) AS v FROM a JOIN a b ON a.j = b.i GROUP BY ALL")
def strassen_2level(spark, sf_dir):
    g = spark.range(256).select(F.floor(F.col("id") / 16).alias("i"), (F.col("id") % 16).alias("j"))
    a = g.withColumn("v", (F.col("i") * 7 + F.col("j") * 3) % 11 - 5)
    b = g.withColumn("v", (F.col("i") * 5 + F.col("j")) % 13 - 6)
    return workloads.strassen(a, b, 16, 2)


def _uts_sql(p: workloads.UtsParams) -> str:
    """The same tree by recursion over hexadecimal states."""
    u = "((('0x' || substr(st, 33, 8))::BIGINT & 2147483647) / 2147483648.0::DOUBLE)"
    shape = {
        "fixed": f"CASE WHEN h < {p.depth} THEN {p.b0}::DOUBLE ELSE 0 END",
        "linear": f"{p.b0}::DOUBLE * (1 - h::DOUBLE / {p.depth})",
        "expdec": f"{p.b0}::DOUBLE * pow(h::DOUBLE, -ln({p.b0}::DOUBLE) / ln({p.depth}::DOUBLE))",
        "cyclic": f"CASE WHEN h > {5 * p.depth} THEN 0 ELSE pow({p.b0}::DOUBLE, sin(2 * pi() * h::DOUBLE / {p.depth})) END",
    }[p.shape]
    b = f"(CASE WHEN h = 0 THEN {p.b0}::DOUBLE ELSE {shape} END)"
    geometric = f"(CASE WHEN {b} > 0 THEN least(100, floor(ln(1 - {u}) / ln(1 - 1 / (1 + {b})))) ELSE 0 END)"
    twofold = f"(CASE WHEN {u} < {p.q}::DOUBLE THEN {p.m} ELSE 0 END)"
    kids = {
        workloads.GEOMETRIC: geometric,
        workloads.BINOMIAL: f"(CASE WHEN h = 0 THEN {int(p.b0)} ELSE {twofold} END)",
        workloads.HYBRID: f"(CASE WHEN h < {p.shift * p.depth} THEN {geometric} ELSE {twofold} END)",
        workloads.BALANCED: f"(CASE WHEN h < {p.depth} THEN {int(p.b0)} ELSE 0 END)",
    }[p.kind]
    kids = f"{kids}::BIGINT"
    root = f"sha1(unhex('{'00' * 16}{p.seed:08x}'))"
    return f"WITH RECURSIVE t(st, h) AS (SELECT {root}, 0 UNION ALL SELECT sha1(unhex(st || printf('%08x', i))), h + 1 FROM (SELECT st, h, unnest(range({kids})) AS i FROM t)) SELECT count(*) AS nodes, count(*) FILTER ({kids} = 0) AS leaves, max(h)::BIGINT AS height FROM t"


_TREES = {
    "uts_fixed": workloads.UtsParams.parse("-t 1 -a 3 -d 5 -b 4 -r 19"),
    "uts_linear": workloads.UtsParams.parse("-t 1 -a 0 -d 6 -b 4 -r 0"),
    "uts_expdec": workloads.UtsParams.parse("-t 1 -a 1 -d 8 -b 4 -r 19"),
    "uts_cyclic": workloads.UtsParams.parse("-t 1 -a 2 -d 5 -b 3 -r 502"),
    "uts_binomial": workloads.UtsParams.parse("-t 0 -b 200 -q 0.2 -m 4 -r 42"),
    "uts_hybrid": workloads.UtsParams.parse("-t 2 -a 0 -d 8 -b 4 -r 1 -q 0.2 -m 4"),
    "uts_balanced": workloads.UtsParams.parse("-t 3 -d 6 -b 4"),
}
for _name, _tree in _TREES.items():
    QUERIES[_name] = lambda spark, sf_dir, p=_tree: workloads.unbalanced_tree(spark, p)
    ORACLE_SQL[_name] = _uts_sql(_tree)


def _ep_sql(bits: int, seed: int = 271828183) -> str:
    """All numbers by doubling: those after k are those up to k, times the multiplier's k-th power."""
    powers = ", ".join(f"({j}, {pow(random.MULTIPLIER, 1 << j, random.MODULUS)}::HUGEINT)" for j in range(bits + 1))
    first = random.lcg(seed)
    return f"""
WITH RECURSIVE p(j, a) AS (VALUES {powers}),
g(j, k, x) AS (SELECT 0, 0::BIGINT, {first}::HUGEINT UNION ALL SELECT g.j + 1, CASE WHEN s = 0 THEN k ELSE k + (1::BIGINT << g.j) END, CASE WHEN s = 0 THEN x ELSE (x * a) % {random.MODULUS} END
  FROM g JOIN p ON p.j = g.j, (VALUES (0), (1)) v(s) WHERE g.j <= {bits}),
u AS (SELECT k, 2 * x::DOUBLE / {random.MODULUS} - 1 AS x FROM g WHERE j = {bits + 1}),
t AS (SELECT a.x AS x, b.x AS y, a.x * a.x + b.x * b.x AS t FROM u a JOIN u b ON b.k = a.k + 1 WHERE a.k % 2 = 0),
d AS (SELECT x * sqrt(-2 * ln(t) / t) AS x, y * sqrt(-2 * ln(t) / t) AS y FROM t WHERE t <= 1)
SELECT round(sum(x), 6) AS sx, round(sum(y), 6) AS sy, {", ".join(f"count(*) FILTER (floor(greatest(abs(x), abs(y))) = {i}) AS q{i}" for i in range(10))} FROM d"""


@query(_ep_sql(16))
def ep_small(spark, sf_dir):
    return workloads.gaussian_pairs(spark, 16).withColumn("sx", F.round("sx", 6)).withColumn("sy", F.round("sy", 6))


@query("SELECT row_number() OVER (ORDER BY vec_id) - 1 AS pos, vec_id AS id, 1::BIGINT AS visits FROM embeddings")
def tsp_visits(spark, sf_dir):
    """Each city's place among the ids and how often the tour visits it; places of the tour have no gap."""
    tour = tsp_tour(spark, sf_dir)
    n = tour.agg(F.max("pos") + 1).first()[0]
    by = tour.where((F.col("pos") >= 0) & (F.col("pos") < n)).groupBy("id").agg(F.count_distinct("pos").alias("visits"))
    return ranges.with_position(by, "id").select("pos", "id", "visits")


@query()
def tsp_tour(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xy")))
    return workloads.tsp(e)


_DIRECT = f"WITH b AS ({_POINT}), p AS (SELECT a.id, b.mass * pow(pow(b.px - a.px, 2) + pow(b.py - a.py, 2) + pow(b.pz - a.pz, 2) + 0.05 * 0.05, -1.5) AS phi, b.px - a.px AS dx, b.py - a.py AS dy, b.pz - a.pz AS dz FROM b a, b) SELECT id, round(sum(phi * dx), 3) AS ax, round(sum(phi * dy), 3) AS ay, round(sum(phi * dz), 3) AS az FROM p GROUP BY id"


@query(_DIRECT)
def barnes_hut_direct(spark, sf_dir):
    """All cells opened: the forces are the direct sums."""
    out = workloads.accelerations(_bodies(spark, sf_dir), tol=1e-9)
    return out.select("id", *(F.round(a, 3).alias(a) for a in ("ax", "ay", "az")))


_PLAN = [([(2, 3), (3, 2)], 0, -1, 2), ([(2, 2), (4, 1)], 1, -1, 3), ([(5, 2), (2, 4)], 2, -1, 4), ([(4, 4), (3, 5), (8, 2)], -1, 1, 0)]


def _floorplan_sql(cells) -> str:
    """Every placement of every alternative, without a bound."""
    shapes = ", ".join(f"({k + 1}, {r}, {c}, {left}, {above}, {after})" for k, (alts, left, above, after) in enumerate(cells) for r, c in alts)
    box = "STRUCT(top BIGINT, bot BIGINT, lhs BIGINT, rhs BIGINT)"
    edge = f"{{'top': 0, 'bot': 0, 'lhs': -1, 'rhs': -1}}::{box}"
    of = lambda k: f"(CASE WHEN {k} = 0 THEN {edge} ELSE placed[{k}] END)"
    return f"""
WITH RECURSIVE a(cell, r, c, l, ab, after) AS (VALUES {shapes}),
s(cur, placed) AS (SELECT 1, []::{box}[] UNION ALL SELECT after, list_append(placed, {{'top': top, 'bot': top + r - 1, 'lhs': lhs, 'rhs': lhs + c - 1}}::{box}) FROM (
  SELECT *, CASE WHEN l >= 0 THEN {of("l")}.rhs + 1 ELSE p END AS lhs, CASE WHEN l >= 0 AND ab >= 0 THEN {of("ab")}.bot + 1 WHEN l >= 0 THEN p ELSE {of("ab")}.bot + 1 END AS top FROM (
    SELECT s.placed, a.*, unnest(CASE
      WHEN l >= 0 AND ab >= 0 THEN CASE WHEN {of("ab")}.bot + 1 <= {of("l")}.bot AND {of("ab")}.bot + 1 + r >= {of("l")}.top AND {of("l")}.rhs + 1 <= {of("ab")}.rhs AND {of("l")}.rhs + 1 + c >= {of("ab")}.lhs THEN [0::BIGINT] ELSE [] END
      WHEN l >= 0 THEN range(greatest({of("l")}.top - r + 1, 0), least({of("l")}.bot, 64) + 1)
      ELSE range(greatest({of("ab")}.lhs - c + 1, 0), least({of("ab")}.rhs, 64) + 1) END) AS p
    FROM s JOIN a ON a.cell = s.cur))
  WHERE len(list_filter(placed, lambda o: NOT (top + r - 1 < o.top OR o.bot < top OR lhs + c - 1 < o.lhs OR o.rhs < lhs))) = 0)
SELECT min((list_max(list_transform(placed, lambda o: o.bot)) + 1) * (list_max(list_transform(placed, lambda o: o.rhs)) + 1))::BIGINT AS area FROM s WHERE cur = 0"""


@query(_floorplan_sql(_PLAN))
def floorplan_small(spark, sf_dir):
    return workloads.floorplan(spark, _PLAN)


@query("SELECT rank::INTEGER AS rank, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM (SELECT c_custkey, ntile(6) OVER (ORDER BY c_custkey) AS rank FROM customer) GROUP BY rank")
def block_distribution(spark, sf_dir):
    placed = balance.block_distribution(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", parts=6)
    return placed.groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))


@query("WITH t AS (SELECT p_partkey, p_size::DOUBLE AS c, coalesce(sum(p_size::DOUBLE) OVER (ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(p_size::DOUBLE) OVER () AS s FROM part) SELECT least(5, floor(b * 5 / s) + 1)::INTEGER AS rank, count(*) AS n, sum(c) AS cost FROM t GROUP BY 1")
def balance_by_cost(spark, sf_dir):
    p = _read(spark, sf_dir, "part").select("p_partkey", "p_size")
    return balance.by_cost(p, F.col("p_size"), "p_partkey", parts=5).groupBy("rank").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query("SELECT round((max(n) - min(n)) / min(n)::DOUBLE, 6) AS imbalance FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_suppkey)")
def imbalance(spark, sf_dir):
    n = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    return balance.imbalance(n).select(F.round("imbalance", 6).alias("imbalance"))


@query("SELECT chunk::INTEGER AS chunk, string_agg(c_custkey::VARCHAR, ',' ORDER BY c_custkey) AS keys FROM (SELECT c_custkey, ntile(4) OVER (ORDER BY c_custkey) AS chunk FROM customer) GROUP BY chunk")
def scatter_gather_roundtrip(spark, sf_dir):
    placed = balance.block_distribution(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", parts=4)
    return loops.gather(placed, "c_custkey", "rank").select(F.col("rank").alias("chunk"), F.array_join(F.transform("values", lambda x: x.cast("string")), ",").alias("keys"))


@query("SELECT o_orderkey, -o_totalprice AS v FROM orders")
def gather_input_negate(spark, sf_dir):
    """The input comes back as the base cases' `pre` has changed it, after the user's own pass over it."""
    flat = Problem(("o_orderkey", "v"), lambda: F.lit(True), lambda: F.array().cast("array<struct<o_orderkey: bigint, v: double>>"), pre=lambda df: df.withColumn("v", -F.col("v")))
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    body = Body({"total": lambda: F.col("v")}, {"total": F.sum})
    return evaluate(rows, flat, body, behavior=Behavior.GATHER_INPUT, gather_input_post=lambda df: df.select("o_orderkey", "v")).input


@query("SELECT round(avg(p_retailprice), 4) AS mean, round(count(*) / sum(1 / p_retailprice), 4) AS harmonic, round(exp(avg(ln(p_retailprice))), 4) AS geometric, round(median(p_retailprice), 4) AS median FROM part")
def stats_means(spark, sf_dir):
    x = F.col("p_retailprice")
    return _read(spark, sf_dir, "part").agg(*(F.round(f(x), 4).alias(k) for k, f in (("mean", stats.mean), ("harmonic", stats.harmonic_mean), ("geometric", stats.geometric_mean), ("median", stats.median))))


_RUNS = "SELECT (l_quantity::INTEGER) AS chunk, l_extendedprice AS speed FROM lineitem"


def _runs(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("int").alias("chunk"), F.col("l_extendedprice").alias("speed"))


@query(f"WITH s AS (SELECT chunk, avg(speed) AS s FROM ({_RUNS}) GROUP BY chunk) SELECT chunk, round(s / (SELECT max(s) FROM s) * 1000000)::BIGINT AS score FROM s")
def chunk_scores(spark, sf_dir):
    return tune.scores(_runs(spark, sf_dir))


_TWICE = "SELECT (2 * l_quantity::INTEGER) AS chunk, l_extendedprice AS speed FROM lineitem"


@query(f"WITH s AS (SELECT chunk, avg(speed) AS s FROM ({_TWICE}) GROUP BY chunk), kept AS (SELECT chunk FROM s WHERE round(s / (SELECT max(s) FROM s) * 1000000)::BIGINT >= 1000000 - 200000), k AS (SELECT DISTINCT unnest([chunk - 1, chunk + 1]) AS chunk FROM kept) SELECT chunk FROM k WHERE chunk BETWEEN 1 AND 90 AND chunk NOT IN (SELECT chunk FROM s)")
def chunk_neighbors(spark, sf_dir):
    """Neighbours of the runs' survivors that no run has measured; all runs count, their chunks being even."""
    r = _runs(spark, sf_dir).withColumn("chunk", 2 * F.col("chunk"))
    return tune.neighbours(tune.survivors(tune.scores(r), tune.tolerance(tune.Options(), -1)), r, 90)


@query(f"WITH s AS (SELECT chunk, max(speed) AS s FROM ({_RUNS}) GROUP BY chunk) SELECT chunk, round(s / (SELECT max(s) FROM s) * 1000000)::BIGINT AS score FROM s ORDER BY score DESC, chunk LIMIT 5")
def topk_report(spark, sf_dir):
    return tune.report(tune.scores(_runs(spark, sf_dir), "max")).limit(5)


@query("SELECT n_nationkey, n_name, (SELECT count(*) FROM customer) AS customers FROM nation")
def broadcast_output(spark, sf_dir):
    return loops.replicate_output(_read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), _read(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("customers")))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY ALL")
def distributed_output(spark, sf_dir):
    """Each rank (here the rows of one flag and status) keeps its own result; nothing is combined over ranks."""
    columns = ("l_returnflag", "l_linestatus", "l_quantity")
    flat = Problem(columns, lambda: F.lit(True), lambda: F.array().cast("array<struct<l_returnflag: string, l_linestatus: string, l_quantity: double>>"))
    body = Body({"n": lambda: F.lit(1).cast("long"), "quantity": lambda: F.col("l_quantity")}, {"n": F.sum, "quantity": F.sum})
    rank = F.struct("l_returnflag", "l_linestatus")
    out = evaluate(_read(spark, sf_dir, "lineitem").select(*columns), flat, body, behavior=Behavior.DISTRIBUTED_INPUT | Behavior.DISTRIBUTED_OUTPUT, rank=rank).value
    return out.select("rank.l_returnflag", "rank.l_linestatus", "n", "quantity")


@query("SELECT max(n) AS most, min(n) AS least FROM (SELECT count(*) AS n FROM events GROUP BY event_type)")
def user_post(spark, sf_dir):
    post = lambda partial: partial.agg(F.max("n").alias("most"), F.min("n").alias("least"))
    return loops.distributed_post(_read(spark, sf_dir, "events"), {"n": F.count(F.lit(1))}, post, F.col("event_type"))


@query("WITH RECURSIVE t(n) AS (SELECT 12 UNION ALL SELECT n - k FROM t, (VALUES (1), (2)) v(k) WHERE n >= 2) SELECT count(*) FILTER (n < 2) AS leaves, count(*) FILTER (n >= 2) AS inner_nodes FROM t")
def nonbase_contrib(spark, sf_dir):
    problem = Problem(("n",), lambda: F.col("n") < 2, lambda: F.array(*(F.struct((F.col("n") - k).alias("n")) for k in (1, 2))))
    one, none = (lambda: F.lit(1)), (lambda: F.lit(0))
    body = Body({"leaves": one, "inner_nodes": none}, {"leaves": F.sum, "inner_nodes": F.sum}, {"leaves": none, "inner_nodes": one})
    out = frontier.fold(spark.createDataFrame([(12,)], "n int"), problem, body, collapse=True)
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("leaves", "inner_nodes")))


@query("SELECT label, vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS norm, dense_rank() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings")
def ranged_problem(spark, sf_dir):
    """Vectors with their place within their label's own range, counted from where that range starts."""
    e = ranges.with_position(_read(spark, sf_dir, "embeddings"), "label", "vec_id")
    starts = e.groupBy("label").agg(F.min("pos").alias("start"))
    e = e.join(F.broadcast(starts), "label")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.select("label", "vec_id", F.round(norm, 4).alias("norm"), (F.col("pos") - F.col("start") + 1).alias("place"))
