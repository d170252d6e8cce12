import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from coppice.functions import random as rnd
from coppice.operators import balance, loops, ranges, workloads
from coppice.operators.problem import levels_for_tasks
from coppice.plans import lineage, tune
from coppice.sources import text


def test_chunks_sweep(spark):
    for n in (98, 100, 102, 21, 23, 25, 1, 0):
        for tasks in (1, 2, 7, 21):
            got = spark.range(n).select(ranges.chunk_of(F.col("id"), F.lit(n), tasks).alias("c")).groupBy("c").count().collect()
            want = {k + 1: n // tasks + (k < n % tasks) for k in range(tasks)}
            assert {r["c"]: r["count"] for r in got} == {k: v for k, v in want.items() if v}


def test_split_and_loops(spark):
    rows = ranges.split_range(spark, 3, 14, 4).orderBy("chunk").collect()
    assert [(r.start, r.end) for r in rows] == [(3, 6), (6, 9), (9, 12), (12, 14)]
    assert loops.pfor_reduce(spark, 5, 5, 3, lambda i: i).first().value is None
    assert loops.pfor_reduce(spark, 0, 10, 3, lambda i: i, F.max).first().value == 9


@pytest.mark.parametrize("n", [0, 1, 7, 20])
def test_fibonacci(spark, n):
    a, b = 0, 1
    for _ in range(n):
        a, b = b, a + b
    assert workloads.fibonacci(spark, n).first().fib == a


def test_positions_have_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    assert [r.pos for r in ranges.with_position(df, "k").orderBy("k").collect()] == list(range(1000))
    assert ranges.with_position(df.limit(0), "k").collect() == []


def test_topological_orders_two_ways(spark):
    e = spark.createDataFrame([(1, 3), (2, 3), (2, 5), (4, 5)], "i int, j int")
    assert workloads.topological_orders(e, 5).first().orders == workloads.order_search(e, 5).first().orders == 16


def test_forces_equal_direct_sums_when_all_cells_open(spark):
    r = np.random.default_rng(1)
    p, m = r.random((40, 3)), r.random(40) + 0.5
    bodies = spark.createDataFrame([(i, float(m[i]), *map(float, p[i])) for i in range(40)], "id long, mass double, px double, py double, pz double")
    got = {x.id: (x.ax, x.ay, x.az) for x in workloads.accelerations(bodies, tol=1e-9, depth=8).collect()}
    d = p[None] - p[:, None]
    r2 = (d**2).sum(axis=2) + 0.05**2
    want = (m[None, :, None] * d / r2[..., None] ** 1.5).sum(axis=1)
    assert max(abs(got[i][k] - want[i, k]) for i in range(40) for k in range(3)) < 1e-6
    assert workloads.accelerations(bodies.limit(0)).collect() == []


def plain_forces(p, m, tol, eps=0.05):
    """Forces by an octree that is halved without a limit; bodies at one place form a leaf."""
    low, side = p.min(axis=0), (p.max(axis=0) - p.min(axis=0)).max() * (1 + 1e-9)
    out = np.zeros(p.shape)

    def visit(cell, d, who):
        place = (p[cell] == p[cell[0]]).all()
        centre = p[cell[0]] if place else (m[cell, None] * p[cell]).sum(axis=0) / m[cell].sum()
        x = centre - p[who]
        r2 = (x**2).sum(axis=1)
        opened = ((side / 2**d / tol) ** 2 >= r2) & (not place)
        out[who[~opened]] += (m[cell].sum() * x / (r2 + eps**2)[:, None] ** 1.5)[~opened]
        if opened.any():
            octant = np.floor((p[cell] - low) / side * 2 ** (d + 1)).astype(int) % 2 @ [4, 2, 1]
            for k in np.unique(octant):
                visit(cell[octant == k], d + 1, who[opened])

    visit(np.arange(len(p)), 0, np.arange(len(p)))
    return out


def direct_forces(p, m, eps=0.05):
    d = p[None] - p[:, None]
    return (m[None, :, None] * d / ((d**2).sum(axis=2) + eps**2)[..., None] ** 1.5).sum(axis=1)


def forces(spark, p, m, **options):
    bodies = spark.createDataFrame([(i, float(m[i]), *map(float, p[i])) for i in range(len(p))], "id long, mass double, px double, py double, pz double")
    return np.array([(x.ax, x.ay, x.az) for x in workloads.accelerations(bodies, **options).orderBy("id").collect()])


def far_off(got, want):
    return np.linalg.norm(got - want, axis=1).max() / np.linalg.norm(want, axis=1).max()


def test_forces_with_an_outlier_and_dense_places(spark):
    r = np.random.default_rng(3)
    p = np.concatenate([r.random((80, 3)), [[100.0] * 3], 0.3 + 1e-4 * r.random((40, 3)), [[0.7, 0.1, 0.2]] * 20])
    m = r.random(len(p)) + 0.5
    got = forces(spark, p, m)
    assert far_off(got, plain_forces(p, m, 0.5)) < 1e-9 and far_off(got, direct_forces(p, m)) < 0.02


def test_forces_of_places_that_the_whole_cube_cannot_part(spark):
    r = np.random.default_rng(4)
    p = np.concatenate([1e-12 * r.random((12, 3)), [[0.0] * 3] * 2, [[-1e6] * 3, [5e5] * 3]])
    m = r.random(len(p)) + 0.5
    assert far_off(forces(spark, p, m, tol=1e-9, eps=1e-13), direct_forces(p, m, 1e-13)) < 1e-9


def test_forces_put_no_pairs_in_tables(spark):
    r = np.random.default_rng(5)
    p, m = r.random((400, 3)), r.random(400) + 0.5
    mark = lineage.written()
    got = forces(spark, p, m, tol=1e-9)
    assert far_off(got, direct_forces(p, m)) < 1e-9
    assert sum(spark.read.parquet(path).count() for _, path in lineage._written[mark:]) < 20 * len(p)


def test_forces_over_many_ranges_and_blocks(spark, monkeypatch):
    for name, v in {"RANGE": 40, "RANGES": 4, "BLOCK": 16, "GROUP": 8, "TILE": 16}.items():
        monkeypatch.setattr(workloads, name, v)
    r = np.random.default_rng(6)
    p = np.concatenate([r.random((150, 3)), 0.3 + 1e-4 * r.random((40, 3)), [[0.7, 0.1, 0.2]] * 5])
    m = r.random(len(p)) + 0.5
    assert far_off(forces(spark, p, m), plain_forces(p, m, 0.5)) < 1e-9
    assert far_off(forces(spark, p, m, tol=1e-9, eps=1e-3), direct_forces(p, m, 1e-3)) < 1e-9
    assert far_off(forces(spark, p, m, eps=0.0), plain_forces(p, m, 0.5, 1e-30)) < 1e-9
    odd = spark.createDataFrame([("a", 1.0, 0.0, 0.0, 0.0), ("b", None, 1.0, 0.0, 0.0), (None, 2.0, 0.0, 1.0, 0.0), ("d", 1.0, None, 0.0, 0.0)], "id string, mass double, px double, py double, pz double")
    got = {x.id: (x.ax, x.ay, x.az) for x in workloads.accelerations(odd, eps=0.0).collect()}
    assert got.keys() == {"a", "b", None, "d"} and np.allclose(got["a"], (0, 2, 0)) and got["d"] == (0, 0, 0)


def test_steps_have_a_body_in_one_row_over_all_ranges(spark, monkeypatch):
    for name, v in {"RANGE": 40, "RANGES": 2, "BLOCK": 32}.items():
        monkeypatch.setattr(workloads, name, v)
    rows, cut = [], lineage.cut

    def counted(df):
        rows.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(lineage, "cut", counted)
    monkeypatch.setattr(workloads, "cut", counted)
    r = np.random.default_rng(7)
    p, m = r.random((300, 3)), r.random(300) + 0.5
    at, v, mark = p, np.zeros(p.shape), lineage.written()
    bodies = spark.createDataFrame([(i, float(m[i]), *map(float, p[i]), 0.0, 0.0, 0.0) for i in range(300)], "id long, mass double, px double, py double, pz double, vx double, vy double, vz double")
    got = workloads.simulate(bodies, 2, 0.001, tol=1e-9).orderBy("id").collect()
    for _ in range(2):
        v = v + 0.001 * direct_forces(at, m)
        at = at + 0.001 * v
    assert np.allclose([[x.px, x.py, x.pz, x.vx, x.vy, x.vz] for x in got], np.hstack([at, v]), rtol=1e-9, atol=1e-12)
    assert max(rows) < 8 * len(p)  # the octree's cells are the most
    assert lineage.written() == mark + 1  # the bodies after the last step


def test_tour_visits_each_point_once(spark):
    r = np.random.default_rng(2)
    p = r.random((120, 2))
    rows = workloads.tsp(spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id long, x double, y double"), leaf=30).orderBy("pos").collect()
    assert sorted(x.id for x in rows) == list(range(120)) and [x.pos for x in rows] == list(range(120))
    length = sum(math.dist(p[a.id], p[b.id]) for a, b in zip(rows, rows[1:] + rows[:1]))
    assert length < 0.4 * sum(math.dist(p[i], p[i - 1]) for i in range(120))


def test_gaussian_sums(spark):
    row = workloads.gaussian_pairs(spark, 12, batch=512).first()
    x, sx, n = 271828183, 0.0, 0
    for _ in range(1 << 12):
        a, b = (x := rnd.lcg(x)), (x := rnd.lcg(x))
        u, v = 2 * a / rnd.MODULUS - 1, 2 * b / rnd.MODULUS - 1
        if (t := u * u + v * v) <= 1:
            sx, n = sx + u * math.sqrt(-2 * math.log(t) / t), n + 1
    assert abs(row.sx - sx) < 1e-8 and sum(row[f"q{i}"] for i in range(10)) == n
    assert rnd.lcg_jump(5, 3) == rnd.lcg(rnd.lcg(rnd.lcg(5)))


def test_balance_and_tuner(spark):
    assert balance.greedy_split([1, 1, 1, 3], 2) == [0, 0, 0, 1]
    assert max(sum(c for c, r in zip([5, 1, 1, 1], balance.refine_split([5, 1, 1, 1], [0, 0, 0, 1], 2)) if r == k) for k in (0, 1)) == 5
    assert levels_for_tasks(2, 9) == 4 and levels_for_tasks(0, 9) == 3 and levels_for_tasks(1, 9) == 0
    assert tune.tolerance(tune.Options(), -1) == 200_000 and tune.tolerance(tune.Options(), 9) == 50_000
    out = tune.autotune(spark, lambda c: None, 1.0).collect()
    assert out[0].score == 1_000_000


def test_readers(spark, tmp_path):
    (tmp_path / "k").write_text("2 10\n3 4 9 5\n")
    items, capacity = text.knapsack(spark, str(tmp_path / "k"))
    assert capacity == 10 and [tuple(r) for r in items.orderBy("k").collect()] == [(0, 9, 5), (1, 3, 4)]
    assert workloads.knapsack(items, capacity).first().best == 12
    (tmp_path / "g").write_text("3 2\n2 1 2 3 a comment")
    edges, n = text.digraph(spark, str(tmp_path / "g"))
    assert n == 3 and sorted(map(tuple, edges.collect())) == [(1, 2), (2, 3)]
    (tmp_path / "b").write_text("1 2 0.1 0.2 0.5\n1 2 3 4 5 6 7")
    rows, head = text.bodies(spark, str(tmp_path / "b"))
    assert rows.count() == 1 and head["tol"] == 0.5


def test_copies_move_by_less_than_the_jitter(spark, tmp_path):
    (tmp_path / "b").write_text("1 2 0.1 0.2 0.5\n1 0 0 0 0 0 0")
    rows, _ = text.bodies(spark, str(tmp_path / "b"), copies=147_120, jitter=0.01)  # the hash of 147,119 and px is 0
    assert rows.where("abs(px) >= 0.01").count() == 0
