"""SimHash near-dedup by segment-popcount embedding.

A 64-bit fingerprint becomes 32 segments of two bits, each mapped to its bit count (0, 1 or 2).  The Manhattan distance
of two such vectors never exceeds the Hamming distance, so fingerprints within RADIUS = 3 bits have vectors within
Manhattan distance 3, and one half of the vector (16 segments) within distance 1.  The **grid range-join** therefore
uses the half-vectors as cells: each fingerprint goes to its own cell and to the cells one count above it (33 or fewer
rows a half); fingerprints meet in a cell if their halves are within 1.  Candidates are then filtered by the Manhattan
bound over all segments and verified by the exact Hamming distance.

Skew: documents with equal fingerprints are one node from the start, so copies cost nothing; the join that gives them
their component deals the rows of a common fingerprint to several tasks.  Cells with one
fingerprint are dropped before any join.  A cell with more than CELL fingerprints is cut into chunks, and each pair of
chunks is verified by a task of its own: memory stays bounded and no pair is lost.  Tasks emit a spanning forest of the
links that they find, never all pairs.

Defined cases: null text counts as empty; texts without words have fingerprint zero and link like any other; repeated
rows and ties share a fingerprint; a null id keeps its row and takes part with no id of its own; an empty table gives
an empty result; other columns pass through (not those named as a result is).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns, schema
from coppice.llm.graph import components
from coppice.plans.lineage import cut
from coppice.plans.skew import HOT, join_hot

RADIUS = 3
SEED = 42
CELL = 4096
_SLICE = 1 << 16  # shingle hashes turned into bits at a time


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle of the ASCII-lower-cased words."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    joined, ends, at = b" ".join(w), [], -1
    for x in w:
        at += len(x) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])], np.uint64)


def _majority(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array of hashes, as uint64."""
    lengths = np.array([len(h) for h in hashes], np.int64)
    counts = np.zeros((len(hashes), 64), np.int64)
    flat, doc = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), lengths)
    for a in range(0, len(flat), _SLICE):
        d = doc[a : a + _SLICE]
        bits = np.unpackbits(flat[a : a + _SLICE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        counts[d[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > lengths[:, None], axis=1).view(">u8").reshape(-1).astype(np.uint64)


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 3) -> DataFrame:
    """`docs` with its text replaced by `fp`, the fingerprint's 64 bits as a long."""
    limit_batches(docs.sparkSession)
    others = other_columns(docs, text_col, "fp")
    frame = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = T.StructType([frame.schema["rest"], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                fp = _majority([shingle_hashes(t, words) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["rest", "fp"])

    return frame.mapInArrow(run, out).select(*(F.col("rest").getField(c).alias(c) for c in others), "fp")


def _cells(distinct: DataFrame) -> DataFrame:
    """(fp, cell, own): a fingerprint's own cell in each half of its count vector, and those one count above."""
    halves = F.array(*(F.struct(F.lit(h).alias("h"), F.shiftrightunsigned("fp", 32 * h).bitwiseAND(F.lit(0xFFFFFFFF)).alias("bits")) for h in (0, 1)))
    counts = F.col("x.bits") - F.shiftright("x.bits", 1).bitwiseAND(F.lit(0x55555555))  # sixteen two-bit counts
    split = distinct.select("fp", F.explode(halves).alias("x")).select("fp", (F.col("x.h").cast("long") * (1 << 33)).alias("base"), counts.alias("v"))
    units = F.array(*(F.lit(1 << 2 * d).cast("long") for d in range(16)))  # a count of one, in each segment
    above = F.transform(F.filter(units, lambda u: F.col("v").bitwiseAND(u * 2) == 0), lambda u: F.col("v") + u)
    own = F.struct(F.col("v").alias("v"), F.lit(True).alias("own"))
    places = F.concat(F.array(own), F.transform(above, lambda x: F.struct(x.alias("v"), F.lit(False).alias("own"))))
    return split.select("fp", "base", F.explode(places).alias("p")).select("fp", (F.col("base") + F.col("p.v")).alias("cell"), F.col("p.own").alias("own"))


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment bit counts of fingerprints."""
    m = np.uint64(0x5555555555555555)
    x, y = ((v - ((v >> np.uint64(1)) & m)) for v in (a, b))
    # |x - y| for two-bit counts: as unary codes (0, 1, 3), the bits that differ
    high = np.uint64(0xAAAAAAAAAAAAAAAA)
    ux, uy = (((v & high) | ((v | (v >> np.uint64(1))) & m)) for v in (x, y))
    return np.bitwise_count(ux ^ uy)


def near(a: np.ndarray, b: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Where a and b are within `radius` bits: the lower bound first, then the exact distance."""
    ok = manhattan(a, b) <= radius
    at = np.flatnonzero(ok)
    a, b = np.broadcast_arrays(a, b)
    ok[at] = np.bitwise_count(a[at] ^ b[at]) <= radius
    return ok


class _Forest:
    """Keeps a link only if it joins two parts."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = p
        return x

    def add(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.up[a] = b
            self.links.append((x, y))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within the cells (or pairs of chunks of a cell) of rows sorted by cell, lo, hi."""
    carry = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        carry = table if carry is None else pa.concat_tables([carry, table])
        last = int(np.flatnonzero(_new(carry))[-1])
        if last:
            yield _linked(carry.slice(0, last))
            carry = carry.slice(last).combine_chunks()
    if carry is not None and carry.num_rows:
        yield _linked(carry)


def _new(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("cell", "lo", "hi"):
        v = table.column(c).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _linked(table: pa.Table) -> pa.RecordBatch:
    fp, own, chunk = table.column("fp").to_numpy(), table.column("own").to_numpy(zero_copy_only=False), table.column("chunk").to_numpy()
    u, forest = fp.view(np.uint64), _Forest()
    lo, hi = table.column("lo").to_numpy(), table.column("hi").to_numpy()
    bounds = np.append(np.flatnonzero(_new(table)), len(fp))
    sizes = np.diff(bounds)
    small = sizes <= 32
    starts, n = bounds[:-1][small], sizes[small]
    for step in range(1, int(n.max(initial=1))):  # pairs of rows `step` apart, in all small cells at once
        live = n > step
        i = np.repeat(starts[live], n[live] - step) + _counting(n[live] - step)
        i = i[own[i] | own[i + step]]
        for k in i[near(u[i], u[i + step])].tolist():
            forest.add(int(fp[k]), int(fp[k + step]))
    for a, b in zip(bounds[:-1][~small].tolist(), bounds[1:][~small].tolist()):
        v, mine, part = u[a:b], own[a:b], chunk[a:b]
        across = lo[a] != hi[a]
        label = np.arange(b - a)
        for i in np.flatnonzero(mine).tolist():
            hit = near(v[i], v)
            hit &= label != label[i]
            if across:
                hit &= part != part[i]
            for j in np.flatnonzero(hit).tolist():
                if label[j] != label[i]:
                    forest.add(int(fp[a + i]), int(fp[a + j]))
                    label[label == label[j]] = label[i]
    pairs = np.array(forest.links, np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])


def _counting(n: np.ndarray) -> np.ndarray:
    """0..n[0]-1, 0..n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def links(distinct: DataFrame) -> DataFrame:
    """(a long, b long): links that connect whatever distinct `fp`s connect at RADIUS bits or fewer."""
    cells = _cells(distinct)
    several = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).where("n > 1 and any_own")
    # Spark guesses both sides' sizes by their source, which is some fifty times smaller: neither may be broadcast
    rows = cells.join(several.select("cell", "n").hint("merge"), "cell")
    chunks = F.ceil(F.col("n") / CELL).cast("int")
    rows = rows.select("cell", "fp", "own", chunks.alias("chunks"), F.pmod(F.xxhash64("fp"), chunks).cast("int").alias("chunk"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    rows = rows.select("cell", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "fp", "own")
    return rows.repartition("cell", "lo", "hi").sortWithinPartitions("cell", "lo", "hi").mapInArrow(_verify, schema("a long, b long"))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, root: bool = False) -> DataFrame:
    """`docs` without its text, with `fp` (long) and `component_id` (the smallest id reachable over links).  Components
    may share that id if ids repeat; `root` adds `root_fp`, a fingerprint that tells them apart."""
    fps = cut(fingerprints(docs, text_col, words))
    distinct = cut(fps.groupBy("fp").agg(F.min(id_col).alias("least_id"), F.count(F.lit(1)).alias("copies")))
    tree = components(links(distinct.select("fp")))
    joined = distinct.join(tree, distinct["fp"] == tree["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    ids = joined.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = joined.join(ids, "root").select("fp", "component_id", *([F.col("root").alias("root_fp")] if root else []))
    out = fps.select(*other_columns(fps, "component_id", *(["root_fp"] if root else [])))
    return join_hot(out, named, "fp", distinct.where(F.col("copies") > HOT).select("fp"))


def op7_simhash(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
