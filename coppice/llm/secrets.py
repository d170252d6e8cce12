"""Secret scans behind a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: a conjunction over the parts that every
match must contain, with disjunctions where the expression branches.  Each batch of documents gets an inverted index of
the trigrams that the queries name; postings are intersected and united, and only candidate documents are verified with
the expression itself.  A rule without mandatory trigrams (such as a run of hexadecimal digits) scans every document.

Defined cases: null text counts as empty; positions are code points, end exclusive; ties of start go by the order of
RULES; repeated rows give repeated results; an empty table gives an empty result; other columns pass through (not those
named as a result is).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product
from re import _constants as K
from re import _parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns


class Rule(NamedTuple):
    kind: str
    pattern: str
    group: int = 0  # the group whose length counts
    least: int = 1  # code points that it needs; shorter matches are dropped, and scanning goes on behind them
    ignore_case: bool = False


# The three base rules, then public formats of credentials.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),  # the same spans as [0-9a-f]+ of 32 or more, as a run is matched from its start
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abposr]-[0-9A-Za-z-]{10,}"),
    Rule("cloud_api", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("payment", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]+-----END [A-Z ]*PRIVATE KEY-----)?"),
    Rule("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    Rule("url_login", r"[A-Za-z][A-Za-z0-9+.-]{0,20}://[^\s/:@]{1,64}:[^\s/@]{3,128}@"),
)
BASE = 3

# ---- Boolean trigram queries: True (no constraint), a trigram, ("all", parts) or ("any", parts) ----------------

_MOST = 64  # strings that a part may stand for before it counts as unknown


def _all(parts) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("all", tuple(parts))


def _any(parts) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("any", tuple(parts))


def _of_strings(strings: set[bytes]) -> object:
    return _any(_all(s[i : i + 3] for i in range(len(s) - 2)) for s in sorted(strings))


def _characters(items) -> set[bytes] | None:
    out = set()
    for op, value in items:
        if op is K.LITERAL:
            out.add(chr(value))
        elif op is K.RANGE and value[1] - value[0] < 8:
            out.update(map(chr, range(value[0], value[1] + 1)))
        else:
            return None
    return {c.lower().encode() for c in out if c.isascii()} if all(c.isascii() for c in out) and len(out) <= 8 else None


def _analyse(tree) -> tuple[set[bytes] | None, object]:
    """All strings that the expression can match (lower case; None: too many), and a query that each match fulfils."""
    run: set[bytes] = {b""}
    finite, need = True, []

    def flush() -> None:
        nonlocal run, finite
        need.append(_of_strings(run))
        run, finite = {b""}, False

    for op, value in tree:
        strings, query = None, True
        if op is K.LITERAL:
            strings = {chr(value).lower().encode()}
        elif op is K.IN:
            strings = _characters(value)
        elif op is K.SUBPATTERN:
            strings, query = _analyse(value[3])
        elif op is K.BRANCH:
            parts = [_analyse(x) for x in value[1]]
            strings = None if any(s is None for s, _ in parts) else set().union(*(s for s, _ in parts))
            query = _any(_of_strings(s) if s is not None else q for s, q in parts)
        elif op in (K.MAX_REPEAT, K.MIN_REPEAT):
            low, high, body = value
            inner, q = _analyse(body)
            query = q if low else True
            if inner is not None and (low, high) == (0, 1):
                strings = inner | {b""}
            elif inner is not None and low == high and low <= 8:
                strings = {b"".join(x) for x in product(*[sorted(inner)] * low)} if len(inner) ** low <= _MOST else None
            elif inner is not None and low:
                run = {a + b for a in run for b in inner} if len(run) * len(inner) <= _MOST else run
        elif op is K.AT:
            strings = {b""}
        if strings is not None and len(run) * len(strings) <= _MOST:
            run = {a + b for a in run for b in strings}
            continue
        flush()
        need.append(query if strings is None else _of_strings(strings))
    if finite:
        return run, _of_strings(run)
    flush()
    return None, _all(need)


def trigram_query(pattern: str) -> object:
    return _analyse(_parser.parse(pattern))[1]


def trigrams(query) -> set[bytes]:
    return {query} if isinstance(query, bytes) else set() if query is True else set().union(*map(trigrams, query[1]))


class TrigramIndex:
    """Postings (ascending document numbers) of the wanted trigrams in a batch of texts."""

    def __init__(self, wanted: set[bytes]) -> None:
        self.number = {t: i for i, t in enumerate(sorted(wanted))}
        self.table = np.full(1 << 24, -1, np.int16)
        for t, i in self.number.items():
            self.table[t[0] << 16 | t[1] << 8 | t[2]] = i
        self.postings: dict[bytes, np.ndarray] = {}
        self.n = 0

    def build(self, texts: list[bytes]) -> None:
        self.n, self.postings = len(texts), {t: np.zeros(0, np.int64) for t in self.number}
        ends = np.cumsum([len(t) + 1 for t in texts])
        b = np.frombuffer(b"\n".join(texts).lower() + b"\n", np.uint8)
        if len(b) < 3 or not self.number:
            return
        found = []
        for a in range(0, len(b) - 2, 1 << 22):
            x = b[a : a + (1 << 22) + 2].astype(np.int32)
            t = self.table[(x[:-2] << 16) | (x[1:-1] << 8) | x[2:]]
            at = np.flatnonzero(t >= 0)
            found.append(t[at].astype(np.int64) * self.n + np.searchsorted(ends, at + a, "right"))
        pairs = np.unique(np.concatenate(found))
        bounds = np.searchsorted(pairs, np.arange(len(self.number) + 1) * self.n)
        for t, i in self.number.items():
            self.postings[t] = pairs[bounds[i] : bounds[i + 1]] - i * self.n

    def candidates(self, query) -> np.ndarray:
        if query is True:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        how, parts = query
        if how == "any":
            return np.unique(np.concatenate([self.candidates(p) for p in parts]))
        out = self.candidates(parts[0])
        for p in parts[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, self.candidates(p), assume_unique=True)
        return out


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(re.compile(r.pattern, re.ASCII | (re.IGNORECASE if r.ignore_case else 0)), r) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = TrigramIndex(set().union(*map(trigrams, self.queries)))

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, rule number, end) of each text's matches, in that order."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        self.index.build([t.encode() for t in texts])
        for k, ((regex, rule), query) in enumerate(zip(self.rules, self.queries)):
            for i in self.index.candidates(query).tolist():
                for m in regex.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        for spans in out:
            spans.sort()
        return out


_scanners: dict[tuple[Rule, ...], Scanner] = {}
REDACTED = "[REDACTED]"


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with the union of its spans replaced, one mark for each maximal run."""
    out, at, end = [], 0, -1
    for start, _, stop in spans:
        if start > end:
            out += [text[at:start], REDACTED]
        end = max(end, stop)
        at = end
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """`docs` without its text, with `found` (array of kind, start, end; by start, then rule) and `redacted` (the text
    with the spans replaced)."""
    limit_batches(docs.sparkSession)
    others = other_columns(docs, text_col, "found", "redacted")
    frame = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    out = T.StructType([frame.schema["rest"], T.StructField("found", T.ArrayType(span)), T.StructField("redacted", T.StringType())])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(rules) or _scanners.setdefault(rules, Scanner(rules))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            found = scanner.scan(texts)
            spans = [[{"kind": rules[k].kind, "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, arrow), pa.array([redact(t, x) if x else t for t, x in zip(texts, found)])], names=out.names)

    return frame.mapInArrow(run, out).select(*(F.col("rest").getField(c).alias(c) for c in others), "found", "redacted")


def op3_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    kinds = [r.kind for r in RULES[:BASE]]

    def line(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in kinds]
    base = F.filter("found", lambda x: x["kind"].isin(kinds))
    return found.select("doc_id", *counts, F.sha2(line(base).cast("binary"), 256).alias("base_sha256"), line(F.col("found")).alias("spans"))
