"""Classic divide-and-conquer workloads as Spark plans."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.functions import random as rnd
from coppice.operators.problem import Body, Problem, Serial, indices
from coppice.plans import granularity
from coppice.plans.frontier import fold, levels, tree_reduce
from coppice.plans.lineage import cut, drop, settle, written


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """Leaves of the tree n -> n - 1, n - 2, summed; equal rows of a level are merged, so levels have at most n rows."""
    problem = Problem(("n",), lambda: F.col("n") < 2, lambda: F.array(*(F.struct((F.col("n") - k).alias("n")) for k in (1, 2))))
    roots = spark.createDataFrame([(n,)], "n int")
    return fold(roots, problem, Body({"fib": lambda: F.col("n").cast("decimal(38,0)")}, {"fib": F.sum}), collapse=True).select(F.col("fib").cast("long").alias("fib"))


def _queens(size: int) -> Problem:
    def children() -> Column:
        b = F.col("board")
        safe = lambda i: ~F.exists(F.transform(b, lambda v, j: (v == i) | (F.abs(v - i) == F.size(b) - j)), lambda z: z)
        return F.transform(F.filter(indices(F.lit(size)), safe), lambda i: F.struct(F.concat(b, F.array(i)).alias("board")))

    return Problem(("board",), lambda: F.size("board") == size, children)


def queens(spark: SparkSession, size: int) -> DataFrame:
    """(solutions, nodes): full boards, and all boards looked at."""
    body = Body({"solutions": lambda: F.lit(1), "nodes": lambda: F.lit(1)}, {"solutions": F.sum, "nodes": F.sum}, {"solutions": lambda: F.lit(0), "nodes": lambda: F.lit(1)})
    out = fold(spark.sql("select array_remove(array(-1), -1) as board"), _queens(size), body)
    return out.select(F.coalesce("solutions", F.lit(0)).cast("long").alias("solutions"), F.col("nodes").cast("long").alias("nodes"))


def queen_boards(spark: SparkSession, size: int) -> DataFrame:
    """(board): all solutions, as columns joined by commas."""
    found = [f.where("__base") for _, f in levels(spark.sql("select array_remove(array(-1), -1) as board"), _queens(size))]
    return found[-1].select(F.array_join("board", ",").alias("board"))


def sort_descending(df: DataFrame, *keys: str) -> DataFrame:
    """Range partition and local sort: quicksort's own plan."""
    return df.orderBy(*(F.desc(k) for k in keys))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, v) of two matrices in coordinates (i, j, v): join on the inner index, sum."""
    right = b.select(F.col("i").alias("k"), F.col("j").alias("j"), F.col("v").alias("w"))
    return a.select("i", F.col("j").alias("k"), "v").join(right, "k").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


# The seven products, as signs of the quadrants (11, 12, 21, 22) of A and B, and their parts in C.
STRASSEN = (((1, 0, 0, 1), (1, 0, 0, 1), (1, 0, 0, 1)), ((0, 0, 1, 1), (1, 0, 0, 0), (0, 0, 1, -1)), ((1, 0, 0, 0), (0, 1, 0, -1), (0, 1, 0, 1)), ((0, 0, 0, 1), (-1, 0, 1, 0), (1, 0, 1, 0)), ((1, 1, 0, 0), (0, 0, 0, 1), (-1, 1, 0, 0)), ((-1, 0, 1, 0), (1, 1, 0, 0), (0, 0, 0, 1)), ((0, 1, 0, -1), (0, 0, 1, 1), (1, 0, 0, 0)))


def strassen(a: DataFrame, b: DataFrame, n: int, depth: int) -> DataFrame:
    """The product of n x n matrices (n divisible by 2^depth) by seven products a level; blocks are keyed rows.

    Matrices of all products of a level are one table keyed by `path`, so each level is two joins with a table of 28
    rows and one aggregate, however many blocks there are.
    """
    spark = a.sparkSession
    split = spark.createDataFrame([(p, q, float(s[q]), float(t[q])) for p, (s, t, _) in enumerate(STRASSEN) for q in range(4)], "p int, q int, s double, t double")
    merge = spark.createDataFrame([(p, q, float(w[q])) for p, (_, _, w) in enumerate(STRASSEN) for q in range(4) if w[q]], "p int, q int, w double")
    sides = [x.select(F.lit("").alias("path"), "i", "j", F.col("v").cast("double").alias("v")) for x in (a, b)]
    size = n
    for _ in range(depth):
        half = size // 2
        quadrant = (F.floor(F.col("i") / half) * 2 + F.floor(F.col("j") / half)).cast("int")
        for k, sign in ((0, "s"), (1, "t")):
            rows = sides[k].withColumn("q", quadrant).join(F.broadcast(split.where(F.col(sign) != 0)), "q")
            rows = rows.select(F.concat("path", F.col("p").cast("string")).alias("path"), (F.col("i") % half).alias("i"), (F.col("j") % half).alias("j"), (F.col("v") * F.col(sign)).alias("v"))
            sides[k] = rows.groupBy("path", "i", "j").agg(F.sum("v").alias("v"))
        size = half
    left, right = sides[0].withColumnRenamed("j", "k"), sides[1].select("path", F.col("i").alias("k"), "j", F.col("v").alias("w"))
    out = left.join(right, ["path", "k"]).groupBy("path", "i", "j").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    for _ in range(depth):
        out = out.withColumn("p", F.substring("path", -1, 1).cast("int")).join(F.broadcast(merge), "p")
        out = out.select(F.expr("substring(path, 1, length(path) - 1)").alias("path"), (F.col("i") + F.floor(F.col("q") / 2) * size).alias("i"), (F.col("j") + F.col("q") % 2 * size).alias("j"), (F.col("v") * F.col("w")).alias("v"))
        out = out.groupBy("path", "i", "j").agg(F.sum("v").alias("v"))
        size *= 2
    return out.select("i", "j", "v")


def tree_add(spark: SparkSession, depth: int) -> DataFrame:
    """The sum over a complete binary tree of `depth` levels of ones, from the leaves up."""
    problem = Problem(("k", "level"), lambda: F.col("level") == depth, lambda: F.array(*(F.struct((F.col("k") * 2 + c).alias("k"), (F.col("level") + 1).alias("level")) for c in (0, 1))))
    out = tree_reduce(spark.createDataFrame([(1, 1)], "k long, level int"), problem, lambda: F.lit(1).cast("long"), lambda kids: F.aggregate(kids, F.lit(1).cast("long"), lambda a, x: a + x))
    return out.select(F.col("value").alias("total"))


def knapsack(items: DataFrame, capacity: int) -> DataFrame:
    """The best value within `capacity`: states are (weight, best value), dominated ones dropped.

    `items`: k, value, weight (no weight is negative).  Blocks of items are solved within tasks and joined pairwise, as the
    best values of a union of items come from those of its parts.  A block's states number at most capacity + 1.
    """
    spark = items.sparkSession
    low = -(1 << 62)

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The best value of a block's own items for each weight: at most capacity + 1 numbers, whatever the block."""
        held = np.full(capacity + 1, low, np.int64)
        held[0] = 0
        for f in frames:
            for w, v in zip(f["weight"], f["value"]):
                if w <= capacity:
                    held[w:] = np.maximum(held[w:], held[: capacity + 1 - w] + v)
        at = np.flatnonzero(held > low // 2)
        yield pd.DataFrame({"w": at, "v": held[at]})

    def join(f: pd.DataFrame) -> pd.DataFrame:
        held = None
        for _, block in f.sort_values("block").groupby("block"):
            own = np.full(capacity + 1, low, np.int64)
            own[block["w"]] = block["v"]
            if held is None:
                held = own
                continue
            out = np.full(capacity + 1, low, np.int64)
            for w in np.flatnonzero(own > low // 2):
                out[w:] = np.maximum(out[w:], held[: capacity + 1 - w] + own[w])
            held = out
        at = np.flatnonzero(held > low // 2)
        return pd.DataFrame({"block": int(f["block"].iloc[0]) // 2, "w": at, "v": held[at]})

    small = items.where(F.col("weight") <= capacity).select(F.col("value").cast("long"), F.col("weight").cast("long"))
    blocks = max(1, min(1024, spark.sparkContext.defaultParallelism * 2))
    states = cut(small.repartition(blocks).mapInPandas(best, "w long, v long").withColumn("block", F.spark_partition_id()))
    while blocks > 1:  # pairs of blocks join, each within a task that holds their states only
        blocks = -(-blocks // 2)
        states = cut(states.groupBy(F.floor(F.col("block") / 2)).applyInPandas(join, "block int, w long, v long"))
    return states.agg(F.coalesce(F.max("v"), F.lit(0)).cast("long").alias("best"))


def topological_orders(edges: DataFrame, n: int) -> DataFrame:
    """How many orders of nodes 1 .. n keep all edges: a level's states are the sets already placed, with their ways."""
    if n > 62:
        raise ValueError("sets of nodes are kept as bits of a long: at most 62 nodes")
    need = {i: 0 for i in range(1, n + 1)}
    for i, j in edges.select("i", "j").collect():  # n * n / 2 pairs at most
        need[j] |= 1 << (i - 1)
    ready = lambda: F.array(*(F.when((F.col("mask").bitwiseAND(F.lit(1 << (i - 1))) == 0) & (F.col("mask").bitwiseAND(F.lit(m)) == m), F.struct(F.col("mask").bitwiseOR(F.lit(1 << (i - 1))).alias("mask"))) for i, m in need.items()))
    problem = Problem(("mask",), lambda: F.col("mask") == (1 << n) - 1, lambda: F.filter(ready(), lambda x: x.isNotNull()))
    root = edges.sparkSession.createDataFrame([(0,)], "mask long")
    out = fold(root, problem, Body({"orders": lambda: F.lit(1)}, {"orders": F.sum}), collapse=True)
    return out.select(F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


def order_search(edges: DataFrame, n: int) -> DataFrame:
    """The same number by reverse search over permutations: children are adjacent swaps whose own parent is this one.
    Which swaps these are (`turn`) is part of the problem: it fixes the search tree."""
    pairs = [tuple(r) for r in edges.select("i", "j").collect()]
    ban = F.array(*(F.lit(i * (n + 1) + j) for i, j in pairs)) if pairs else F.array().cast("array<int>")

    def children() -> Column:
        v = F.col("v")
        first = F.array_position(F.transform(indices(F.lit(n - 1)), lambda k: F.get(v, k) >= F.get(v, k + 1)), F.lit(True)).cast("int")
        s = F.when(first > 0, first - 1).otherwise(n - 1)
        free = lambda i: ~F.array_contains(ban, F.get(v, i) * (n + 1) + F.get(v, i + 1))
        turn = lambda i: (i <= s - 1) | ((i == s + 1) & (s <= n - 3) & (F.get(v, s) < F.get(v, s + 2)))
        swap = lambda i: F.struct(F.transform(v, lambda x, k: F.when(k == i, F.get(v, i + 1)).when(k == i + 1, F.get(v, i)).otherwise(x)).alias("v"))
        return F.transform(F.filter(indices(F.lit(n - 1)), lambda i: free(i) & turn(i)), swap)

    problem = Problem(("v",), lambda: F.lit(False), children)
    root = edges.sparkSession.createDataFrame([(list(range(1, n + 1)),)], "v array<int>")
    out = fold(root, problem, Body({}, {"orders": F.sum}, {"orders": lambda: F.lit(1)}))
    return out.select(F.col("orders").cast("long").alias("orders"))


BINOMIAL, GEOMETRIC, HYBRID, BALANCED = "binomial", "geometric", "hybrid", "balanced"
MOST_KIDS = 100


@dataclass(frozen=True)
class UtsParams:
    """Parameters of an unbalanced tree; the letters are those of the usual command line."""

    kind: str = GEOMETRIC  # t
    shape: str = "linear"  # a: linear, expdec, cyclic or fixed
    depth: int = 6  # d: where geometric trees end
    b0: float = 4.0  # b: mean number of children (the root's own number in a binomial tree)
    q: float = 15 / 64  # chance of a binomial inner node
    m: int = 4  # its children
    shift: float = 0.5  # f: share of the depth at which a hybrid tree turns binomial
    seed: int = 0  # r

    @classmethod
    def parse(cls, line: str) -> UtsParams:
        """Of an option line such as `-t 1 -a 3 -d 10 -b 4 -r 19`."""
        kinds, shapes = (BINOMIAL, GEOMETRIC, HYBRID, BALANCED), ("linear", "expdec", "cyclic", "fixed")
        words, found = line.split(), {}
        for option, value in zip(words[::2], words[1::2]):
            key = {"-t": "kind", "-a": "shape", "-d": "depth", "-b": "b0", "-q": "q", "-m": "m", "-f": "shift", "-r": "seed"}.get(option)
            if key is None:
                raise ValueError(f"unknown option {option}")
            found[key] = kinds[int(value)] if key == "kind" else shapes[int(value)] if key == "shape" else int(value) if key in ("depth", "m", "seed") else float(value)
        return cls(**found)

    def mean(self, height: int) -> float:
        """The mean number of children of a geometric node."""
        if not height:
            return self.b0
        if self.shape == "expdec":
            return self.b0 * height ** (-math.log(self.b0) / math.log(self.depth))
        if self.shape == "cyclic":
            return 0.0 if height > 5 * self.depth else self.b0 ** math.sin(2 * math.pi * height / self.depth)
        if self.shape == "fixed":
            return self.b0 if height < self.depth else 0.0
        return self.b0 * (1 - height / self.depth)

    def kids(self, state: bytes, height: int) -> int:
        """The number of children of a node."""
        if self.kind == BALANCED:
            return int(self.b0) if height < self.depth else 0
        if self.kind == BINOMIAL and not height:
            return int(self.b0)
        u = rnd.uniform(state)
        if self.kind == BINOMIAL or (self.kind == HYBRID and height >= self.shift * self.depth):
            return min(MOST_KIDS, self.m if u < self.q else 0)
        b = self.mean(height)
        return min(MOST_KIDS, math.floor(math.log(1 - u) / math.log(1 - 1 / (1 + b)))) if b > 0 else 0

    def kids_column(self) -> Column:
        """The same over columns state and height."""
        h, u = F.col("height"), rnd.sha_uniform(F.col("state"))
        if self.kind == BALANCED:
            return F.when(h < self.depth, int(self.b0)).otherwise(0)
        twofold = F.when(u < self.q, min(MOST_KIDS, self.m)).otherwise(0)
        if self.kind == BINOMIAL:
            return F.when(h == 0, int(self.b0)).otherwise(twofold)
        shapes = {
            "expdec": lambda: self.b0 * F.pow(h, F.lit(-math.log(self.b0) / math.log(self.depth))),
            "cyclic": lambda: F.when(h > 5 * self.depth, 0.0).otherwise(F.pow(F.lit(self.b0), F.sin(2 * math.pi * h / self.depth))),
            "fixed": lambda: F.when(h < self.depth, self.b0).otherwise(0.0),
            "linear": lambda: self.b0 * (1 - h / self.depth),
        }
        b = F.when(h == 0, self.b0).otherwise(shapes[self.shape]())
        kids = F.when(b > 0, F.least(F.lit(MOST_KIDS), F.floor(F.ln(1 - u) / F.ln(1 - 1 / (1 + b))))).otherwise(0)
        return F.when(h >= self.shift * self.depth, twofold).otherwise(kids) if self.kind == HYBRID else kids

    def problem(self) -> Problem:
        """The tree with nodes (state, height, kids)."""

        def children() -> Column:
            none = F.lit(None).cast("int").alias("kids")
            return F.transform(indices(F.col("kids")), lambda i: F.struct(rnd.sha_child(F.col("state"), i).alias("state"), (F.col("height") + 1).alias("height"), none))

        serial = Serial(
            lambda x: not x["kids"], lambda x: [{"state": rnd.child(x["state"], i), "height": x["height"] + 1, "kids": None} for i in range(int(x["kids"]))],
            lambda x: {"nodes": 1, "leaves": 1, "tall": x["height"]}, lambda x: {"nodes": 1, "leaves": 0, "tall": x["height"]}, pre=lambda x: {**x, "kids": self.kids(x["state"], int(x["height"]))},
        )
        pre = lambda df: df.withColumn("kids", self.kids_column().cast("int"))
        return Problem(("state", "height", "kids"), lambda: F.col("kids") == 0, children, pre, serial=serial)


def unbalanced_tree(spark: SparkSession, params: UtsParams, partitioner: str = "automatic", budget: int = granularity.BUDGET) -> DataFrame:
    """(nodes, leaves, height) of a random tree whose nodes' states come from SHA-1.

    The top levels are rows; sub-trees end within tasks, each at most `budget` nodes at a time, as trees are very uneven."""
    root = spark.createDataFrame([(bytearray(rnd.root(params.seed)), 0, None)], "state binary, height int, kids int")
    values = T.StructType([T.StructField(k, T.LongType()) for k in ("nodes", "leaves", "tall")])
    rows = granularity.contributions(root, params.problem(), values, partitioner, budget=budget)
    return rows.agg(F.sum("nodes").alias("nodes"), F.sum("leaves").alias("leaves"), F.max("tall").alias("height"))


def gaussian_pairs(spark: SparkSession, log2_pairs: int, batch: int = 1 << 12, seed: int = 271828183) -> DataFrame:
    """Sums of Gaussian deviates and counts by annulus, from pairs of 46-bit congruential numbers.

    Each batch (the last may be shorter) jumps to its own place of the sequence, so batches are independent."""
    pairs = 1 << log2_pairs
    batches = -(-pairs // batch)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps = rnd.lcg_powers(2 * batch)
        for f in frames:
            rows = []
            for k in f["id"]:
                n = min(batch, pairs - int(k) * batch)
                u = rnd.lcg_many(rnd.lcg_jump(seed, 2 * int(k) * batch), steps[: 2 * n])
                p = 2 * u.reshape(-1, 2) / rnd.MODULUS - 1
                t = (p**2).sum(axis=1)
                p, t = p[t <= 1], t[t <= 1]
                g = p * np.sqrt(-2 * np.log(t) / t)[:, None]
                q = np.bincount(np.abs(g).max(axis=1).astype(int), minlength=10)[:10] if len(g) else np.zeros(10, int)
                rows.append((g[:, 0].sum(), g[:, 1].sum(), *q.tolist()))
            yield pd.DataFrame(rows, columns=["sx", "sy", *(f"q{i}" for i in range(10))])

    counts = [f"q{i}" for i in range(10)]
    tasks = min(batches, max(spark.sparkContext.defaultParallelism, batches // 256))
    out = spark.range(0, batches, 1, tasks).mapInPandas(run, "sx double, sy double, " + ", ".join(f"{q} long" for q in counts))
    return out.agg(F.sum("sx").alias("sx"), F.sum("sy").alias("sy"), *(F.sum(q).alias(q) for q in counts))


def bounding_box(df: DataFrame, *axes: str) -> DataFrame:
    return df.agg(*(f(a).cast("double").alias(f"{k}_{a}") for a in axes for k, f in (("min", F.min), ("max", F.max))))


def octants(bodies: DataFrame, depth: int) -> DataFrame:
    """(path, mass, px, py, pz, n): the cells of each depth to `depth` that hold bodies; the root's path is empty."""
    box = bounding_box(bodies, "px", "py", "pz").first()
    low = [box[f"min_{a}"] or 0.0 for a in ("px", "py", "pz")]
    side = max([(box[f"max_{a}"] or 0.0) - lo for a, lo in zip(("px", "py", "pz"), low)] + [1e-12]) * (1 + 1e-9)
    digits = []
    for d in range(1, depth + 1):
        bits = [F.floor((F.col(a) - lo) / side * (1 << d)).cast("long") % 2 for a, lo in zip(("px", "py", "pz"), low)]
        digits.append((bits[0] * 4 + bits[1] * 2 + bits[2]).cast("string"))
    full = bodies.withColumn("leaf", F.concat(*digits))
    cells = full.select(F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("d"), "*").withColumn("path", F.expr("substring(leaf, 1, d)"))
    mean = lambda a: (F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a)
    return cells.groupBy("path").agg(F.sum("mass").alias("mass"), mean("px"), mean("py"), mean("pz"), F.count(F.lit(1)).alias("n"), F.min("id").alias("least_id")).withColumn("side", F.lit(side) / F.pow(F.lit(2.0), F.length("path")))


HALVINGS = 48  # of a cube, as many as doubles tell places apart
RANGE = 1 << 14  # cells that a task descends at a time
RANGES = 1 << 7  # of them in a pass over the bodies: some 120 MB, which each task holds
BLOCK = 1 << 12  # bodies that go to a task together
GROUP, TILE = 64, 256  # bodies and cells whose distances are taken at once


def _cubes(rest: DataFrame) -> DataFrame:
    """`rest` with the cube of the bodies of each path: its side, and the bodies' places in it (0 to 1) as ux, uy, uz."""
    axes = ("px", "py", "pz")
    box = rest.groupBy("path").agg(*(f(a).alias(f"{k}_{a}") for a in axes for k, f in (("min", F.min), ("max", F.max))))
    span = F.greatest(*(F.col(f"max_{a}") - F.col(f"min_{a}") for a in axes)) * (1 + 1e-9)
    box = box.select("path", *(f"min_{a}" for a in axes), F.when(span == 0, 1.0).otherwise(span).alias("cube"))
    places = (F.least((F.col(a) - F.col(f"min_{a}")) / F.col("cube"), F.lit(1 - 2.0**-53)).alias(f"u{a[1]}") for a in axes)
    return cut(rest.select("path", "mass", *axes).join(box, "path").select("path", "mass", *axes, "cube", *places))


def octree(bodies: DataFrame, step: int) -> DataFrame:
    """(path, mass, px, py, pz, n, place, side): cells that hold bodies, halved until a cell's bodies are at one `place`.

    A pass makes `step` levels, of the bodies whose cells aren't finished.  After HALVINGS levels the bodies of each cell
    get a cube of their own; it parts at least two places, so passes end however close bodies are.  Bodies without
    coordinates are in no cell."""
    axes = ("px", "py", "pz")
    rest = _cubes(bodies.select(F.lit("").alias("path"), F.col("mass").cast("double").alias("mass"), *(F.col(a).cast("double").alias(a) for a in axes)).dropna(subset=axes))
    root = rest.select("cube").first()
    if root is not None and not math.isfinite(root["cube"]):
        raise ValueError("the bodies' coordinates must be finite, and so must their differences")
    made: DataFrame | None = None
    base = halved = 0
    while True:
        if halved == HALVINGS:
            rest, halved = _cubes(rest), 0
        levels_ = min(step, HALVINGS - halved)
        digits = []
        for d in range(halved + 1, halved + levels_ + 1):
            bits = [F.floor(F.col(u) * float(1 << d)) % 2 for u in ("ux", "uy", "uz")]
            digits.append((bits[0] * 4 + bits[1] * 2 + bits[2]).cast("string"))
        rest = rest.withColumn("path", F.concat("path", *digits))
        cells = rest.select(F.explode(F.sequence(F.lit(base + (base > 0)), F.lit(base + levels_))).alias("d"), "*").withColumn("path", F.expr("substring(path, 1, d)"))
        one = F.lit(True)
        for a in axes:
            one = one & (F.min(a) == F.max(a))
        mean = lambda a: F.when(one, F.min(a)).otherwise(F.sum(F.col("mass") * F.col(a)) / F.sum("mass")).alias(a)
        side = F.min("cube") / F.pow(F.lit(2.0), F.length("path") - (base - halved))
        cells = cut(cells.groupBy("path").agg(F.sum("mass").alias("mass"), *(mean(a) for a in axes), F.count(F.lit(1)).alias("n"), one.alias("place"), side.alias("side")))
        made = cells if made is None else made.unionByName(cells)
        base, halved = base + levels_, halved + levels_
        open_ = cells.where((F.length("path") == base) & ~F.col("place")).select("path")
        if open_.isEmpty():
            return made
        rest = cut(rest.join(open_, "path", "left_semi"))


def _z_order(bodies: DataFrame) -> Column:
    """A body's place along the octree's order, to twelve halvings."""
    box, bits = bounding_box(bodies, "px", "py", "pz").first(), []
    side = max(box[f"max_p{a}"] - box[f"min_p{a}"] for a in "xyz") or 1.0
    for k, a in enumerate("xyz"):
        at = F.least(F.floor((F.col(f"p{a}") - box[f"min_p{a}"]) / side * 4096), F.lit(4095)).cast("long")
        bits += [F.shiftleft(F.shiftright(at, d).bitwiseAND(F.lit(1)), 3 * d + 2 - k) for d in range(12)]
    return functools.reduce(Column.bitwiseOR, bits)


def _pack_bodies(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (id, x, y, z) to a row for each `size` of them: the ids, and as three rows of doubles the places and pulls of 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in _sized(batches, size):
            xyz = np.stack([f.column(a).to_numpy() for a in "xyz"])
            ids = f.column("id").combine_chunks()
            ids = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([ids, pa.array([xyz.tobytes()]), pa.array([bytes(xyz.nbytes)])], names=["ids", "xyz", "pulls"])

    return run


def _sized(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of `batches` as tables of `size` rows; the last has the rest."""
    kept, n = [], 0
    for batch in batches:
        kept.append(batch)
        n += batch.num_rows
        if n >= size:
            table = pa.Table.from_batches(kept)
            for at in range(0, n - size + 1, size):
                yield table.slice(at, size)
            rest = table.slice(n - n % size).combine_chunks()
            kept, n = rest.to_batches(), rest.num_rows
    if n:
        yield pa.Table.from_batches(kept)


_CELL = ("mass", "px", "py", "pz", "side")  # of a cell, as doubles


def _pack_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cells by path to a row for each RANGE of them, without what is below a place: the first cell's path, the doubles,
    and for each cell whether it is a place, its level and its parent (its number in the range, or -1 - the parent's
    level if it lies before the range, as only cells above the first do)."""
    for f in _sized(batches, RANGE):
        paths, places = f.column("path").to_pylist(), f.column("place").to_pylist()
        keep, parents, above, last = [], [], {}, None
        for i, (path, place) in enumerate(zip(paths, places)):
            if last is not None and path.startswith(last):
                continue
            last = path if place else last
            parents.append(above.get(path[:-1], -len(path)) if path else 0)
            above[path] = len(keep)
            keep.append(i)
        data = np.stack([f.column(c).to_numpy()[keep] for c in _CELL])
        whole = np.array([[places[i] for i in keep], [len(paths[i]) for i in keep], parents], np.int32)
        yield pa.RecordBatch.from_arrays([pa.array([paths[0]]), pa.array([data.tobytes()]), pa.array([whole.tobytes()])], names=["first", "data", "whole"])


class _Range:
    """A range of cells and the cells above its first, by level."""

    def __init__(self, first: str, data: bytes, whole: bytes, above: dict[str, tuple], tol: float) -> None:
        top = [above[first[:k]] for k in range(len(first))]
        own, (place, level, parent) = np.frombuffer(data).reshape(5, -1), np.frombuffer(whole, np.int32).reshape(3, -1)
        n = len(top)
        self.mass, self.px, self.py, self.pz, side = np.concatenate([np.array([t[:5] for t in top]).reshape(-1, 5).T, own], axis=1)
        self.place = np.concatenate([np.array([t[5] for t in top], bool), place.astype(bool)])
        self.reach = np.where(self.place, -1.0, (side / tol) ** 2)  # opened by bodies within this squared distance
        self.above = n  # these only open or close what is below
        self.parent = np.concatenate([np.arange(-1, n - 1), np.where(parent < 0, -1 - parent, parent + n)])
        self.parent[:1] = -1
        level = np.concatenate([np.arange(n), level])
        order = np.argsort(level, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(level[order])) + 1)

    def pull(self, xyz: np.ndarray, eps: float, out: np.ndarray) -> None:
        """Adds to `out` the range's accelerations of the bodies at xyz (three rows): a level's cells whose parents any of
        them opens are held against all of them at once, but for those that all must open as they're within reach of the
        bodies' box."""
        column, n = np.full(len(self.mass), -1), xyz.shape[1]
        x, y, z = (v[:, None] for v in xyz)
        low, high = xyz.min(axis=1), xyz.max(axis=1)
        open_ = None  # bodies by cells of the level above: who opens what; None if all open all
        for depth, cells in enumerate(self.levels):
            if depth:
                cells = cells[column[self.parent[cells]] >= 0]
            far = sum(np.maximum((p[cells] - u) ** 2, (p[cells] - v) ** 2) for p, u, v in zip((self.px, self.py, self.pz), low, high))
            sure = self.reach[cells] >= far
            c = cells[sure]
            column[c], width = np.arange(len(c)), len(c)
            kept = [np.ones((n, len(c)), bool) if open_ is None else open_[:, column[self.parent[c]]]]
            cells = cells[~sure]
            for at in range(0, len(cells), TILE):
                c = cells[at : at + TILE]
                dx, dy, dz = self.px[c] - x, self.py[c] - y, self.pz[c] - z
                q = dx * dx
                q += dy * dy
                q += dz * dz
                acts = None  # who is pulled by what; None if all by all
                if not self.place[c].all():
                    opens = self.reach[c] >= q
                    acts = ~opens
                    if open_ is not None:
                        opens &= open_[:, column[self.parent[c]]]
                    some = np.flatnonzero(opens.any(axis=0))
                    column[c[some]] = width + np.arange(len(some))
                    width += len(some)
                    kept.append(opens[:, some])
                if open_ is not None:
                    live = open_[:, column[self.parent[c]]]
                    acts = live if acts is None else acts & live
                if c[0] < self.above:
                    acts = (c >= self.above) if acts is None else acts & (c >= self.above)
                if acts is not None and not acts.any():
                    continue
                if eps * eps:
                    q += eps * eps
                else:  # a body's own place doesn't pull it
                    acts = q > 0 if acts is None else acts & (q > 0)
                    q[q == 0] = 1.0
                w = np.sqrt(q)
                w *= q
                np.divide(self.mass[c], w, out=w)
                if acts is not None:
                    w *= acts
                for k, d in enumerate((dx, dy, dz)):
                    out[k] += np.einsum("ij,ij->i", w, d)
            if not width:
                return
            open_ = np.concatenate(kept, axis=1)
            open_ = None if open_.all() else open_


def _pull(above: dict[str, tuple], tol: float, eps: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of a block of bodies and a range of cells to the blocks, the ranges of a block's successive rows added to its pulls."""
    names = ["block", "ids", "xyz", "pulls"]

    def done(row: pa.RecordBatch, out: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(row.column(c) for c in names[:3]), pa.array([out.tobytes()])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = row = x = out = None
        for batch in batches:
            for i in range(batch.num_rows):
                if (block := batch.column("block")[i].as_py()) != at:
                    if at is not None:
                        yield done(row, out)
                    at, row = block, batch.slice(i, 1)
                    x, out = (np.frombuffer(row.column(c)[0].as_py()).reshape(3, -1) for c in names[2:])
                    out = out.copy()
                cells = _Range(*(batch.column(c)[i].as_py() for c in ("first", "data", "whole")), above, tol)
                for k in range(0, x.shape[1], GROUP):
                    cells.pull(x[:, k : k + GROUP], eps, out[:, k : k + GROUP])
        if at is not None:
            yield done(row, out)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks to a row for each body."""
    for batch in batches:
        for i in range(batch.num_rows):
            pulls = np.frombuffer(batch.column("pulls")[i].as_py()).reshape(3, -1)
            yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, *map(pa.array, pulls)], names=["id", "ax", "ay", "az"])


def accelerations(bodies: DataFrame, tol: float = 0.5, eps: float = 0.05, depth: int = 6) -> DataFrame:
    """(id, ax, ay, az) by the opening test: a cell far enough for its size acts as one body.

    Blocks of near bodies meet ranges of cells, and each task descends its range from the root, so that pairs of bodies and
    cells are in no table, however many cells `tol` opens.  A pass takes RANGES of them and adds to the blocks' pulls, so that
    a body is in one row however many ranges there are; files that are done with go.  Cells go down to single places, so near bodies always act one
    by one; bodies at the same place act as one, and not on each other.  `depth` levels of cells are made in one pass."""
    spark, axes = bodies.sparkSession, ("px", "py", "pz")
    mark = written()
    cells = octree(bodies, depth)
    made = written()
    root = cells.where("path = ''").first()
    if root is None:
        return bodies.select("id", *(F.lit(0.0).alias(k) for k in ("ax", "ay", "az")))
    # cells of no mass that is known have no centre: always opened, and of no weight
    known = [F.coalesce("mass", F.lit(0.0)).alias("mass"), *(F.coalesce(a, F.lit(0.0)).alias(a) for a in axes), F.when(F.col("px").isNull(), float("inf")).otherwise(F.col("side")).alias("side")]
    known = cells.select("path", *known, "place")
    parts = max(1, cells.count() // RANGE)
    ranges_ = cut(known.repartitionByRange(parts, "path").sortWithinPartitions("path").mapInArrow(_pack_cells, "first string, data binary, whole binary"))
    firsts = sorted(r["first"] for r in ranges_.select("first").collect())  # one for each range
    need = spark.createDataFrame([(p,) for p in sorted({f[:k] for f in firsts for k in range(len(f))})], "path string")
    above = {r["path"]: (*(r[c] for c in _CELL), r["place"]) for r in known.join(F.broadcast(need), "path").collect()}
    drop(mark, made)

    n, tasks = root["n"], 4 * spark.sparkContext.defaultParallelism
    size = min(BLOCK, max(GROUP, -(-n // tasks)))
    placed = bodies.select("id", *(F.col(a).cast("double").alias(a[1]) for a in axes), _z_order(bodies).alias("z_order")).dropna(subset=["x", "y", "z"])
    doubles = [T.StructField(k, T.BinaryType()) for k in ("xyz", "pulls")]
    shape = T.StructType([T.StructField("ids", T.ArrayType(bodies.schema["id"].dataType)), *doubles])
    blocks = placed.repartitionByRange(-(-n // (16 * BLOCK)), "z_order").sortWithinPartitions("z_order").select("id", "x", "y", "z").mapInArrow(_pack_bodies(size), shape)
    mark = written()
    blocks = cut(blocks.select(F.monotonically_increasing_id().alias("block"), "*"))
    blocks = settle(blocks.repartitionByRange(max(tasks, -(-n // (4 * BLOCK))), "block"), mark)
    # a row has a block and a range: up to 2 MB; a file of blocks is a task's
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": "16", "spark.sql.files.openCostInBytes": spark.conf.get("spark.sql.files.maxPartitionBytes")}
    before = {key: spark.conf.get(key) for key in held}
    for key, v in held.items():
        spark.conf.set(key, v)
    try:
        for at in range(0, len(firsts), RANGES):
            some = firsts[at : at + RANGES]
            few = ranges_.where(F.col("first").between(some[0], some[-1])).coalesce(1)
            pairs = blocks.join(few.hint("shuffle_replicate_nl"))
            blocks = settle(pairs.mapInArrow(_pull(above, tol, eps), blocks.schema), mark)
        out = T.StructType([bodies.schema["id"], *(T.StructField(k, T.DoubleType()) for k in ("ax", "ay", "az"))])
        out = settle(blocks.mapInArrow(_unpack, out), mark)
    finally:
        for key, v in before.items():
            spark.conf.set(key, v)
    total = out.groupBy("id").agg(*(F.sum(k).alias(k) for k in ("ax", "ay", "az")))
    return bodies.select("id").join(total, "id", "left").na.fill(0.0)


def advance(bodies: DataFrame, acc: DataFrame, dt: float) -> DataFrame:
    """One leapfrog step."""
    out = bodies.join(acc, "id")
    for a in "xyz":
        out = out.withColumn(f"v{a}", F.col(f"v{a}") + F.col(f"a{a}") * dt).withColumn(f"p{a}", F.col(f"p{a}") + F.col(f"v{a}") * dt)
    return out.select(*bodies.columns)


def simulate(bodies: DataFrame, steps: int, dt: float, tol: float = 0.5, eps: float = 0.05) -> DataFrame:
    """`bodies` (id, mass, positions, velocities) after `steps` leapfrog steps; of their files the last bodies stay."""
    mark = written()
    for _ in range(steps):
        bodies = settle(advance(bodies, accelerations(bodies, tol, eps), dt), mark)
    return bodies


def _tour(points: np.ndarray) -> np.ndarray:
    """Order of a tour by closest-point insertion."""
    tour = [0]
    for i in range(1, len(points)):
        p = points[tour]
        near = int(((p - points[i]) ** 2).sum(axis=1).argmin())
        after, before = (near + 1) % len(tour), near - 1
        d = lambda a, c: math.dist(points[a], points[c])
        grow = lambda u, w: d(u, i) + d(i, w) - d(u, w)
        tour.insert(near + 1 if grow(tour[near], tour[after]) <= grow(tour[before], tour[near]) else near, i)
    return np.array(tour)


def _join_tours(a: list, b: list) -> list:
    """The shorter of the joins of two tours at the closest pair of a sample of their points, with b either way."""
    pa_, pb = np.array([x[1:] for x in a]), np.array([x[1:] for x in b])
    i = int(((pa_ - pb.mean(axis=0)) ** 2).sum(axis=1).argmin())
    j = int(((pb - pa_[i]) ** 2).sum(axis=1).argmin())
    a, b = a[i + 1 :] + a[: i + 1], b[j:] + b[:j]
    ways = [a + b, a + b[:1] + b[:0:-1], a + b[::-1], a + b[1:] + b[:1]]
    d = lambda t: math.dist(t[len(a) - 1][1:], t[len(a)][1:]) + math.dist(t[-1][1:], t[0][1:])
    inner = lambda t: sum(math.dist(t[k][1:], t[k + 1][1:]) for k in (len(a), len(t) - 2) if k + 1 < len(t))
    return min(ways, key=lambda t: d(t) + inner(t))


def tsp(points: DataFrame, leaf: int = 150, depth: int | None = None) -> DataFrame:
    """(pos, id, x, y): a tour of the points (id, x, y) by Karp's partition.

    Points are halved at medians of alternating axes until a part has about `leaf`; each part's tour is made in a task,
    and tours are joined pairwise upwards.  The last joins hold whole tours, which is the result's own size."""
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n / leaf)))) if depth is None else depth
    parts = points.select("id", "x", "y", F.lit("").alias("part"))
    for d in range(depth):
        axis = "xy"[d % 2]
        middle = parts.groupBy("part").agg(F.percentile_approx(axis, 0.5).alias("m"))
        parts = cut(parts.join(middle, "part").select("id", "x", "y", F.concat("part", F.when(F.col(axis) <= F.col("m"), "0").otherwise("1")).alias("part")))

    def solve(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id").iloc[:].reset_index(drop=True)
        order = _tour(f[["x", "y"]].to_numpy())
        return pd.DataFrame({"part": [f["part"][0]], "tour": [[{"id": int(f["id"][k]), "x": float(f["x"][k]), "y": float(f["y"][k])} for k in order]]})

    shape = "part string, tour array<struct<id: long, x: double, y: double>>"
    tours = parts.groupBy("part").applyInPandas(solve, shape)

    def join(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("part")
        tour: list = []
        for t in f["tour"]:
            t = [(p["id"], p["x"], p["y"]) for p in t]
            tour = _join_tours(tour, t) if tour else t
        return pd.DataFrame({"part": [f["part"].iloc[0][:-1]], "tour": [[{"id": i, "x": x, "y": y} for i, x, y in tour]]})

    for _ in range(depth):
        tours = cut(tours).withColumn("up", F.expr("substring(part, 1, length(part) - 1)")).groupBy("up").applyInPandas(lambda f: join(f.drop(columns="up")), shape)
    return tours.select(F.posexplode("tour").alias("pos", "p")).select("pos", "p.id", "p.x", "p.y")


Cell = tuple[list[tuple[int, int]], int, int, int]  # (rows, columns) alternatives, left, above (-1: none, 0: edge), next (0: last)
_EDGE = (0, 0, -1, -1)  # top, bottom, left and right side of what stands for the board's edge
BOARD = 64


def corners(rows: int, columns: int, left: tuple | None, above: tuple | None) -> list[tuple[int, int]]:
    """Where a cell's upper left corner may lie, beside what is to its left and below what is above it."""
    if left and above:
        top, side = above[1] + 1, left[3] + 1
        touches = top <= left[1] and top + rows >= left[0] and side <= above[3] and side + columns >= above[2]
        return [(top, side)] if touches else []
    if left:
        return [(top, left[3] + 1) for top in range(max(left[0] - rows + 1, 0), min(left[1], BOARD) + 1)]
    return [(above[1] + 1, side) for side in range(max(above[2] - columns + 1, 0), min(above[3], BOARD) + 1)]


def placements(cells: list[Cell], placed: dict[int, tuple], at: int) -> list[dict[int, tuple]]:
    """`placed` with cell `at` (from 1) added in every way that covers no other cell."""
    shapes, left, above, _ = cells[at - 1]
    side = lambda k: None if k < 0 else _EDGE if not k else placed[k]
    out = []
    for rows, columns in shapes:
        for top, lhs in corners(rows, columns, side(left), side(above)):
            box = (top, top + rows - 1, lhs, lhs + columns - 1)
            if all(box[1] < o[0] or o[1] < box[0] or box[3] < o[2] or o[3] < box[2] for o in placed.values()):
                out.append({**placed, at: box})
    return out


def footprint(placed: dict[int, tuple]) -> int:
    return (max(b[1] for b in placed.values()) + 1) * (max(b[3] for b in placed.values()) + 1)


def search_floorplan(cells: list[Cell], state: tuple[int, dict], best: int, budget: int) -> tuple[int, list[tuple[int, dict]]]:
    """(least area found under `best`, states left open) of at most `budget` states, depth first, small areas first."""
    stack, seen = [state], 0
    while stack and seen < budget:
        at, placed = stack.pop()
        seen += 1
        after = cells[at - 1][3]
        grown = sorted(((footprint(p), k, p) for k, p in enumerate(placements(cells, placed, at))), reverse=True)
        for area, _, p in grown:
            if area < best and not after:
                best = area
            elif area < best:
                stack.append((after, p))
    return best, [(at, p) for at, p in stack if not p or footprint(p) < best]


def floorplan(spark: SparkSession, cells: list[Cell], tasks: int | None = None, budget: int = 20_000) -> DataFrame:
    """The least area of a rectangle that holds all cells, by branch and bound.

    A short search on the driver gives the first bound and the states to deal out; each round, tasks search at most
    `budget` states below theirs, and the next round takes the least area and the states still open under it."""
    tasks = tasks or spark.sparkContext.defaultParallelism
    best, todo = search_floorplan(cells, (1, {}), (BOARD * BOARD) * 4, 50 * len(cells))
    schema = "best long, at int, placed array<array<int>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows, bound = [], int(f["best"].min()) if len(f) else 0
            for at, placed in zip(f["at"], f["placed"]):
                bound, left = search_floorplan(cells, (int(at), {int(x[0]): tuple(int(v) for v in x[1:]) for x in placed}), bound, budget)
                rows += [(bound, a, [[k, *b] for k, b in p.items()]) for a, p in left]
            yield pd.DataFrame([(bound, None, None), *rows], columns=["best", "at", "placed"], dtype=object)

    rows = spark.createDataFrame([(best, at, [[k, *b] for k, b in p.items()]) for at, p in todo], schema)
    while not rows.isEmpty():
        done = cut(rows.repartition(tasks).mapInPandas(run, schema))
        best = min(best, done.agg(F.min("best")).first()[0])
        rows = done.where("at is not null").withColumn("best", F.lit(best).cast("long"))
    return spark.createDataFrame([(best,)], "area long")
