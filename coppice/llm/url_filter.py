"""URL filters over a sorted digest array.

Rules (host and path start) are keyed by the 64-bit xxHash of their text; the sorted keys, the texts and the verdicts
lie in one file that every executor receives once and memory-maps.  A batch of URLs is probed at once: each of its
host suffixes with each path start of a length that rules have is one candidate, found by vectorised binary search and
confirmed against the stored text, so colliding digests do no harm.  The longest rule that fits wins (ties: the one
with the longer host).

The file is shipped whole, so its size is checked (MOST_BYTES); beyond, `judge_by_join` gives the same result with a
shuffle join on the candidates' texts, whose rules may be of any number.

Defined cases: a null url, or one without `://`, has the empty host and path and fits no rule; if one rule is listed
twice, block wins; no rules: all get the default verdict; an empty table gives an empty result; repeated rows give
repeated results; other columns pass through (not those named as a result is).
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns
from coppice.plans.skew import row_hash

MOST_BYTES = 512 << 20
SALTS = 16
_host_end = re.compile(r"[/?#]")
_path_end = re.compile(r"[?#]")


def split_url(url: str | None) -> tuple[str, str]:
    """(host with A-Z lower-cased, path)."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    cut = _host_end.search(rest)
    host, tail = (rest[: cut.start()], rest[cut.start() :]) if cut else (rest, "")
    cut = _path_end.search(tail)
    return host.encode().lower().decode(), tail[: cut.start()] if cut else tail


def _rule_parts(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


class DigestArray:
    """Sorted 64-bit keys of rules with their texts; kept as one file, read by memory map."""

    def __init__(self, data: np.ndarray) -> None:
        n, lengths = (int(x) for x in data[:16].view(np.int64))
        at = 16
        self.path_lengths = data[at : at + 8 * lengths].view(np.int64).tolist()
        at += 8 * lengths
        self.keys = data[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.offsets = data[at : at + 8 * (n + 1)].view(np.int64)
        at += 8 * (n + 1)
        self.block = data[at : at + n]
        self.texts = data[at + n :]

    @staticmethod
    def pack(rules: Iterable[tuple[str, str]], key=xxhash.xxh64_intdigest) -> bytes:
        """The file of (rule, verdict) pairs."""
        verdicts: dict[str, bool] = {}
        for rule, verdict in rules:
            verdicts[rule] = verdicts.get(rule, False) or verdict == "block"
        rows = sorted((key(r.encode()), r.encode(), b) for r, b in verdicts.items())
        lengths = sorted({len(_rule_parts(r)[1]) for r in verdicts})
        ends = np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype(np.int64)
        keys, block = np.array([k for k, _, _ in rows], np.uint64), np.array([b for _, _, b in rows], np.uint8)
        return b"".join([np.array([len(rows), len(lengths), *lengths], np.int64).tobytes(), keys.tobytes(), ends.tobytes(), block.tobytes(), *(r for _, r, _ in rows)])

    def candidates(self, host: str, path: str) -> list[bytes]:
        starts = [path[:n] for n in self.path_lengths if n <= len(path)]
        at, out = 0, []
        while True:
            out += [(host[at:] + p).encode() for p in starts]
            at = host.find(".", at) + 1
            if not at:
                return out

    def probe(self, texts: list[bytes], key=xxhash.xxh64_intdigest) -> np.ndarray:
        """The rule's number for each candidate, or -1."""
        out = np.full(len(texts), -1)
        if not texts or not len(self.keys):
            return out
        digests = np.array([key(t) for t in texts], np.uint64)
        at = np.searchsorted(self.keys, digests)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests).tolist():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == digests[i]:  # rules with one digest stand side by side
                if self.texts[self.offsets[k] : self.offsets[k + 1]].tobytes() == texts[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """The longest fitting rule and whether it blocks, for each (host, path)."""
        texts: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(parts):
            found = self.candidates(host, path) if host or path else []
            texts += found
            owner += [i] * len(found)
        best: list[tuple[int, int, str, bool] | None] = [None] * len(parts)
        hits = self.probe(texts)
        for j in np.flatnonzero(hits >= 0).tolist():
            rule = texts[j].decode()
            value = (len(rule), len(_rule_parts(rule)[0]), rule, bool(self.block[hits[j]]))
            if best[owner[j]] is None or value > best[owner[j]]:
                best[owner[j]] = value
        return [None if b is None else b[2:] for b in best]


_shipped: set[tuple[str, str]] = set()
_opened: dict[str, DigestArray] = {}


def _ship(spark, data: bytes) -> str:
    """Sends the file to all executors, once for each application and content; its name there."""
    name = f"url-rules-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    sc = spark.sparkContext
    if (sc.applicationId, name) not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="coppice-"), name)
        with open(path, "wb") as f:
            f.write(data)
        sc.addFile(os.path.realpath(path))
        _shipped.add((sc.applicationId, name))
    return name


def judge(pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """`pages` with host, path, rule (null if none fits) and verdict."""
    spark = pages.sparkSession
    limit_batches(spark)
    data = DigestArray.pack(rules)
    if len(data) > MOST_BYTES:
        return judge_by_join(pages, spark.createDataFrame(rules, "rule string, verdict string"), url_col, default)
    name = _ship(spark, data)
    others = other_columns(pages, "host", "path", "rule", "verdict")
    frame = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{url_col}`").cast("string").alias("url"))
    text = T.StringType()
    out = T.StructType([frame.schema["rest"], *(T.StructField(c, text) for c in ("host", "path", "rule", "verdict"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _opened:
            _opened[name] = DigestArray(np.memmap(SparkFiles.get(name), np.uint8, "r"))
        array = _opened[name]
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = array.judge(parts)
            columns = ([h for h, _ in parts], [p for _, p in parts], [f and f[0] for f in found], [default if f is None else "block" if f[1] else "allow" for f in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns)], names=out.names)

    return frame.mapInArrow(run, out).select(*(F.col("rest").getField(c).alias(c) for c in others), "host", "path", "rule", "verdict")


def judge_by_join(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The same for rules (columns rule, verdict) of any number: candidates meet rules in a shuffle join.

    The lengths of rules' paths are collected (distinct numbers only)."""
    others = other_columns(pages, "host", "path", "rule", "verdict")
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    base = pages.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.pmod(row_hash(pages, *others), F.lit(SALTS)).cast("int").alias("salt"), rest.alias("url"))
    base = base.select("rest", "salt", F.translate(F.regexp_extract("url", r"^([^/?#]*)", 1), upper, lower).alias("host"), F.regexp_extract("url", r"^[^/?#]*(/[^?#]*)?", 1).alias("path"))
    one = rules.groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("block"))
    rule_path = F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1)
    lengths = [r[0] for r in one.select(F.char_length(rule_path)).distinct().collect()]
    sites = base.select("host", "path").distinct().where("host <> '' or path <> ''")
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.array(*(F.when(F.char_length("path") >= n, F.substring("path", 1, n)) for n in lengths)) if lengths else F.array().cast("array<string>")
    tries = sites.withColumn("s", F.explode(suffixes)).withColumn("p", F.explode(F.filter(starts, lambda x: x.isNotNull())))
    # all sites of a common rule (or pages of a common site) would meet in one place: each is dealt to SALTS
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALTS)).cast("int").alias("salt")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
    hits = tries.select("host", "path", "s", F.concat("s", "p").alias("rule"), salt("host", "path")).join(one.select("rule", "block", salts), ["rule", "salt"])
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.char_length("rule").alias("n"), F.char_length("s").alias("h"), "rule", "block")).alias("best"))
    out = base.join(best.select("host", "path", "best", salts), ["host", "path", "salt"], "left")
    verdict = F.when(F.col("best.block"), "block").when(~F.col("best.block"), "allow").otherwise(default)
    return out.select(*(F.col("rest").getField(c).alias(c) for c in others), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


# Fixed values.
RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), RULES).drop("url")


OP2_SQL = r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM r),
rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
hit AS (
  SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM u JOIN rules ON (host = rh OR suffix(host, '.' || rh)) AND starts_with(path, rp))
SELECT u.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN hit ON u.page_id = hit.page_id AND k = 1
"""
