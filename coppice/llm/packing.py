"""Best-fit packing planned on the histogram of piece lengths.

Documents are tokenized, end with id 0 and are cut into pieces of at most LENGTH tokens (the first may be shorter).
The plan needs only the count of each length (LENGTH numbers whatever the corpus): best-fit in order of falling length,
where all sequences with the same contents are one group with a count.  Each length makes at most two new groups, so a
plan has at most a few thousand groups; its slots are broadcast (rows are bounded by LENGTH, not by the data).

Pieces then take slots by rank within their length.  A length may be that of a third of all pieces, so ranks are
counted in two steps: within (length, bucket) by a window, plus the bucket's offset from a count.  A length's buckets grow
with its pieces, which are dealt by a number of their own, whatever their ids.

Defined cases: null text counts as empty and becomes the one id 0; repeated rows are packed as often as they occur; an
empty table gives an empty result; other columns are not carried.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from coppice.llm._arrow import limit_batches, schema
from coppice.llm._chunks import ChunkCache
from coppice.llm.bpe import read_ranks
from coppice.plans.lineage import cut

LENGTH = 2048
END = 0
CELL = 1 << 15  # pieces of a length and bucket at most, about
SPLIT = 64  # buckets of a length that has fewer: n pieces have n / CELL + SPLIT * LENGTH buckets at most
VOCABULARY = "byte_bpe_50k.tiktoken"  # the vocabulary of byte_bpe_50k.json as ranks
ADDED = "byte_bpe_50k.json"  # lists the added tokens, which the ranks lack

_caches: dict[tuple[str, str | None], ChunkCache] = {}


def added_tokens(path: str) -> dict[str, int]:
    """Texts that a tokenizer's file gives an id of their own, wherever they stand."""
    with open(path, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    if any(t[k] for t in listed for k in ("single_word", "lstrip", "rstrip", "normalized")) or any(re.search(r"\s", t["content"]) for t in listed):
        raise ValueError(f"{path}: added tokens that hold white space or don't match as they stand")
    return {t["content"]: t["id"] for t in listed}


def _tokenizer(path: str, added: str | None) -> ChunkCache:
    """Ids as the tokenizers library gives them for the same vocabulary (tests compare the two); from ranks, chunks
    that the cache lacks cost a fraction of that library's time for each call.  Texts are split at the tokens that the
    file `added` lists; without it these are text like any other."""
    if (path, added) not in _caches:
        import tiktoken

        t = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
        own = added_tokens(added) if added else {}
        split = re.compile("(" + "|".join(map(re.escape, sorted(own, key=len, reverse=True))) + ")").split

        def encode(text: str) -> bytes:
            if not any(k in text for k in own):
                return array("I", t.encode_ordinary(text)).tobytes()
            ids = array("I")
            for k, part in enumerate(split(text)):
                ids.extend([own[part]] if k % 2 else t.encode_ordinary(part))
            return ids.tobytes()

        _caches[path, added] = ChunkCache(encode)
    return _caches[path, added]


def cut_points(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids."""
    first = n % length or min(n, length)
    return [(0, first), *((s, length) for s in range(first, n, length))]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, keep_ids: bool = False, added: str | None = None) -> DataFrame:
    """A row for each piece of each document; `ids` (little-endian unsigned 32-bit) is null unless asked for.

    `added` names a file whose added tokens become their ids."""
    limit_batches(docs.sparkSession)
    path = path or public_tokenizers.path(VOCABULARY)
    end = int(END).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path, added)
        for batch in batches:
            rows = []
            for id_, ids in zip(batch.column(0).to_pylist(), tokenizer.batch([t or "" for t in batch.column(1).to_pylist()])):
                ids += end
                for k, (start, n) in enumerate(cut_points(len(ids) // 4, length)):
                    own = ids[4 * start : 4 * (start + n)]
                    rows.append((id_, k, start, n, zlib.crc32(own), own if keep_ids else None))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = zip(*rows) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[x.split(" ")[0] for x in _PIECES.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema(_PIECES))


def plan(counts: dict[int, int], length: int = LENGTH) -> list[tuple[int, tuple]]:
    """Best-fit over counts: [(how many sequences, ((piece length, how many, offset), ...)), ...]."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}  # room left -> groups of equal sequences
    open_rooms: list[int] = []
    done = []

    def put(room: int, n: int, held: tuple) -> None:
        if n and room:
            if room not in rooms:
                rooms[room] = []
                bisect.insort(open_rooms, room)
            rooms[room].append((n, held))
        elif n:
            done.append((n, held))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(open_rooms, size)  # the least room that fits
            room = open_rooms[at] if at < len(open_rooms) else length
            fit = room // size
            if at < len(open_rooms):
                n, held = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    open_rooms.pop(at)
            else:
                n, held = max(1, -(-left // fit)), ()
            full = min(n, left // fit)
            put(room - fit * size, full, (*held, (size, fit, length - room)))
            left -= full * fit
            if full < n and left:
                put(room - left * size, 1, (*held, (size, left, length - room)))
                full, left = full + 1, 0
            put(room, n - full, held) if held else None
    return done + [(n, held) for groups in rooms.values() for n, held in groups]


def slots(groups: list[tuple[int, tuple]]) -> dict[str, np.ndarray]:
    """The plan as intervals of rank within each length, sorted by length and first rank."""
    rows, used, sequence = [], {}, 0
    for n, held in groups:
        for size, fit, offset in held:
            first = used.get(size, 0)
            rows.append((size, first, fit, sequence, offset))
            used[size] = first + n * fit
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("size", "first", "fit", "sequence", "offset"), table.T.copy()))


_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, sequence_id long, offset long"


def pack(parts: DataFrame, length: int = LENGTH) -> DataFrame:
    """`parts` (as `pieces` gives them) with sequence_id and offset."""
    spark = parts.sparkSession
    parts = cut(parts.withColumn("spread", F.xxhash64(F.monotonically_increasing_id())))  # written, so it never changes
    total = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # LENGTH rows at most
    table = slots(plan(total, length))
    buckets = np.ones(length + 1, np.int64)
    for size, n in total.items():
        buckets[size] = max(-(-n // CELL), min(SPLIT, -(-n // SPLIT)))
    wide = [(int(k), int(n)) for k, n in enumerate(buckets) if n > 1]
    bucket = F.lit(0)
    if wide:
        many = spark.createDataFrame(wide, "length long, buckets long")
        parts = parts.join(F.broadcast(many), "length", "left")
        bucket = F.pmod("spread", F.coalesce("buckets", F.lit(1))).cast("int")
    parts = parts.withColumn("bucket", bucket)
    first = np.cumsum(buckets) - buckets
    counts = np.zeros(int(buckets.sum()), np.int64)
    for r in parts.where(F.col("bucket") >= 0).groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")).collect() if wide else ():
        counts[first[r["length"]] + r["bucket"]] = r["n"]
    running = np.cumsum(counts) - counts
    shared = spark.sparkContext.broadcast((first, running - running[first.repeat(buckets)], table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, before, t = shared.value
        for batch in batches:
            size, bucket, rank = (batch.column(batch.schema.names.index(c)).to_numpy() for c in ("length", "bucket", "rank"))
            rank = before[first[size] + bucket] + rank - 1
            lo, hi = np.searchsorted(t["size"], size, "left"), np.searchsorted(t["size"], size, "right")
            while (wide := lo + 1 < hi).any():  # the last slot of the length whose first rank isn't beyond
                mid = np.where(wide, (lo + hi) // 2, lo)
                below = t["first"][mid] <= rank
                lo, hi = np.where(wide & below, mid, lo), np.where(wide & ~below, mid, hi)
            k = rank - t["first"][lo]
            sequence, offset = t["sequence"][lo] + k // t["fit"][lo], t["offset"][lo] + k % t["fit"][lo] * size
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sequence), pa.array(offset)], names=[x.split(" ")[0] for x in _PLACED.split(", ")])

    order = Window.partitionBy("length", "bucket").orderBy("spread")
    return parts.select(*[x.split(" ")[0] for x in _PIECES.split(", ")], "bucket", F.row_number().over(order).alias("rank")).mapInArrow(run, schema(_PLACED))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None, keep_ids: bool = False, added: str | None = None) -> DataFrame:
    return pack(pieces(docs, id_col, text_col, length, path, keep_ids, added), length)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), added=public_tokenizers.path(ADDED)).drop("ids")
