"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a **minimal perfect hash** over the vocabulary (hash and displace: a bucket's displacement seeds the second
hash; buckets of one key store their slot) finds a whole pre-token's id, confirmed by the stored bytes.  Tier two, for
pre-tokens outside the vocabulary: merges by lowest rank, leftmost first, with a **heap over linked bytes**.

The vocabulary (bounded by its file) is read on the driver and broadcast with the hash tables.

Defined cases: null text counts as empty (no ids); any text round-trips; repeated rows give repeated results; an empty
table gives an empty result; other columns pass through (not those named as a result is).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns, schema
from coppice.llm._chunks import ChunkCache, Generations

MULTI = "byte_bpe_multi_50k.tiktoken"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PerfectHash:
    """A minimal perfect hash from token bytes to ids."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        digest, n = xxhash.xxh64_intdigest, len(ranks)
        self.n, self.buckets = n, max(1, n // 3)
        groups: dict[int, list[bytes]] = {}
        for token in ranks:
            groups.setdefault(digest(token, 0) % self.buckets, []).append(token)
        self.shift = [0] * self.buckets
        slots: list[bytes | None] = [None] * n
        for b in sorted(groups, key=lambda b: -len(groups[b])):
            if len(groups[b]) == 1:
                continue
            d = 1
            while True:
                places = {digest(t, d) % n for t in groups[b]}
                if len(places) == len(groups[b]) and all(slots[p] is None for p in places):
                    break
                d += 1
            self.shift[b] = d
            for t in groups[b]:
                slots[digest(t, d) % n] = t
        free = (i for i, t in enumerate(slots) if t is None)
        for b, tokens in groups.items():
            if len(tokens) == 1:
                slots[i := next(free)] = tokens[0]
                self.shift[b] = -i - 1
        self.tokens = slots
        self.ids = [ranks[t] for t in slots]

    def get(self, token: bytes) -> int | None:
        if not self.n:
            return None
        d = self.shift[xxhash.xxh64_intdigest(token, 0) % self.buckets]
        slot = -d - 1 if d < 0 else xxhash.xxh64_intdigest(token, d) % self.n
        return self.ids[slot] if self.tokens[slot] == token else None


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str = public_tokenizers.PATTERN) -> None:
        self.hash, self.pattern, self.ranks = PerfectHash(ranks), pattern, ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self._findall = self._met = None

    def merge(self, token: bytes) -> list[int]:
        """Ids of a pre-token that is not itself in the vocabulary."""
        get, n = self.ranks.get, len(token)
        end = list(range(1, n + 1))  # a live part starts at i and ends at end[i]; links go by these
        before = list(range(-1, n))
        live = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(token[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, to = pop(heap)
            mid = end[i]
            if not live[i] or mid >= n or end[mid] != to:
                continue  # one of the two parts has changed since
            end[i], live[mid] = to, False
            if to < n:
                before[to] = i
                if (r := get(token[i : end[to]])) is not None:
                    push(heap, (r, i, end[to]))
            if (p := before[i]) >= 0 and (r := get(token[p:to])) is not None:
                push(heap, (r, p, to))
        out, i = [], 0
        while i < n:
            out.append(get(token[i : end[i]]))
            i = end[i]
        return out

    def look_up(self, token: str) -> bytes:
        b = token.encode()
        i = self.hash.get(b)
        ids = self.merge(b) if i is None else (i,)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit bytes."""
        if self._findall is None:
            self._findall, self._met = regex.compile(self.pattern).findall, Generations(self.look_up)
        return b"".join(map(self._met.__getitem__, self._findall(text)))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_findall": None, "_met": None}


_caches: dict[str, ChunkCache] = {}


def encode(docs: DataFrame, text_col: str = "text", path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """`docs` without its text, with `ids` (binary: little-endian unsigned 32-bit) and `decoded` (binary)."""
    spark = docs.sparkSession
    limit_batches(spark)
    path = path or public_tokenizers.path(MULTI)
    model = spark.sparkContext.broadcast(Bpe(read_ranks(path), pattern))
    others = other_columns(docs, text_col, "ids", "decoded")
    frame = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = T.StructType([frame.schema["rest"], *schema("ids binary, decoded binary")])
    key = f"{path}\n{pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model.value
        cache = _caches.setdefault(key, ChunkCache(bpe.encode))  # kept while the worker lives
        for batch in batches:
            ids = cache.batch([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.binary())], names=out.names)

    return frame.mapInArrow(run, out).select(*(F.col("rest").getField(c).alias(c) for c in others), "ids", "decoded")


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digests of `encode`; hashed by Spark, so ids and bytes never leave the tasks."""
    done = encode(docs.select(id_col, text_col), text_col)
    return done.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
