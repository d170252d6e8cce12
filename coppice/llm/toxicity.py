"""Toxicity by compression distance.

A text is cut into windows of about WINDOW bytes, and each is compressed with zstandard dictionaries: one trained on
windows of ordinary documents, and two trained on windows of toxic documents (each with the ordinary content behind it, so
that only what is toxic tells them apart).  The bytes that both toxic dictionaries save against the ordinary one say how
close a window is to toxic text.

As most windows of a toxic document are ordinary, windows are labelled anew before the dictionaries are trained: toxic
documents fall in two folds (near copies begin alike and share one), a first dictionary is trained on all windows of
either fold, and a window of the other fold counts as toxic if that dictionary saves more on it than on the most telling
windows of ordinary documents (quantile CLEAR), but not nearly all of it, as it would on a copy.  The two final
dictionaries are trained on what either fold has left.

A document's savings are condensed to a few numbers and calibrated to a probability by logistic regression, on rows that
trained no dictionary.  All settings were chosen on rows that may be learnt from.

The model is fitted on the driver from a bounded sample: at most SAMPLE labelled rows of each class whose texts have at
most SAMPLE_BYTES bytes, in the order of a hash of the id.  Scoring covers every window of every whole text.

Defined cases: null text counts as empty and gets the score of a text without windows (finite, 0 to 1); repeated rows
get equal scores; labels that are null or of missing documents are ignored; with one class or none every score is the
sample's toxic share (0 if there are no labels); an empty table gives an empty result; other columns pass through (not
those named as a result is).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coppice.llm._arrow import limit_batches, other_columns

WINDOW = 64
SAMPLE = 4000
SAMPLE_BYTES = 8192
DICTIONARY = 8192
ORDINARY = 1 << 17
SEGMENT = {DICTIONARY: 24, ORDINARY: 32}  # bytes that the trainer takes at a time
CLEAR = 0.999
COPY = 20  # bytes that only a copy saves
START = 40  # characters by which near copies fall in one fold
COMMON = 600  # ordinary documents that the savings of a fold are held against
THRESHOLD = 0.3
STRATEGY = zstandard.STRATEGY_BTULTRA
HASH = 17
CHAIN = 16  # bounds the search: newer content, which is ordinary, is met before toxic content that is ordinary too
SEARCH = 6
MATCH = 3
_blank = re.compile(rb"[\x09-\x0d\x20]")


def windows(text: str | None) -> list[bytes]:
    """The whole text, lower-cased, as runs of WINDOW bytes or more that end before white space; a run without any ends
    between characters after 2 * WINDOW bytes."""
    b = (text or "").encode().lower()
    out, at = [], 0
    while at < len(b):
        end = min(at + 2 * WINDOW, len(b))
        if len(b) - at > WINDOW:
            space = _blank.search(b, at + WINDOW, end)
            if space:
                end = space.start()
            while end < len(b) and b[end] & 0xC0 == 0x80:
                end -= 1
        out.append(b[at:end])
        at = end
    return out


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary trained on the distinct `samples`; if they are too few to train on, these themselves."""
    distinct = list(dict.fromkeys(samples))
    if len(distinct) >= 100 and sum(map(len, distinct)) > 2 * size:
        try:
            return zstandard.train_dictionary(size, distinct, k=SEGMENT[size], d=6, accel=1).as_bytes()
        except zstandard.ZstdError:  # the trainer found too little in them
            pass
    return b"".join(distinct)[-size:]


class Sizes:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        self._compressor = None

    def __call__(self, parts: list[bytes]) -> np.ndarray:
        if self._compressor is None:
            d = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            how = zstandard.ZstdCompressionParameters(window_log=20, hash_log=HASH, chain_log=CHAIN, search_log=SEARCH, min_match=MATCH, strategy=STRATEGY, write_content_size=0, write_dict_id=0, write_checksum=0)
            d.precompute_compress(compression_params=how)
            self._compressor = zstandard.ZstdCompressor(dict_data=d, compression_params=how)
        compress = self._compressor.compress
        return np.array([len(compress(p)) for p in parts], np.int64)

    def __getstate__(self) -> dict:
        return {"content": self.content, "_compressor": None}


def features(savings: np.ndarray) -> np.ndarray:
    """What calibration sees of a document: its best windows, the share of windows with a clear saving, its length."""
    if not len(savings):
        return np.zeros(5)
    best = np.minimum(np.sort(savings)[::-1], 9)
    second, third = (float(best[k]) if len(best) > k else 0.0 for k in (1, 2))
    return np.array([best[0], second, third, np.sqrt((savings >= 3).mean()), np.log1p(len(savings))])


class Model:
    def __init__(self, toxic: list[Sizes], ordinary: Sizes | None, weights: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.toxic, self.ordinary, self.weights, self.mean, self.scale = toxic, ordinary, weights, mean, scale

    def savings(self, parts: list[bytes]) -> np.ndarray:
        """Bytes that every toxic dictionary saves on each window."""
        return self.ordinary(parts) - np.max([t(parts) for t in self.toxic], axis=0)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.ordinary is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.weights[-1])))
        x = np.array([features(self.savings(windows(t))) for t in texts]).reshape(-1, len(self.mean))
        return 1 / (1 + np.exp(-np.clip(((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _fold(text: str | None) -> int:
    return xxhash.xxh64_intdigest((text or "")[:START]) % 2


def relabelled(toxic: list[str | None], common: list[bytes], ordinary: Sizes) -> list[list[bytes]]:
    """For each fold of the toxic texts, the windows that the other fold's dictionary tells from `common` windows."""
    parts: list[list[bytes]] = [[], []]
    for t in toxic:
        parts[_fold(t)].extend(windows(t))
    usual, out = ordinary(common), []
    for f in (0, 1):
        other = Sizes(_dictionary(parts[1 - f], DICTIONARY) + ordinary.content)
        limit = max(1.0, float(np.quantile(usual - other(common), CLEAR))) if common else 1.0
        saved = ordinary(parts[f]) - other(parts[f])
        out.append([parts[f][k] for k in np.flatnonzero((saved >= limit) & (saved <= COPY)).tolist()])
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept (last) by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), ridge * len(x) * np.eye(x.shape[1])
    keep[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(texts: list[str | None], toxic: list[int], share: float | None = None) -> Model:
    """A model from labelled texts; `share`: how large the toxic share is outside the sample (else as in it)."""
    y = np.array(toxic, float)
    share = float(y.mean()) if share is None and len(y) else share or 0.0
    if not len(y) or y.min() == y.max():
        base = np.clip(share, 1e-6, 1 - 1e-6)
        return Model([], None, np.array([np.log(base / (1 - base))]), np.zeros(0), np.ones(0))
    half = np.empty(len(y), bool)  # of either class, one half trains dictionaries and the other calibrates
    for c in (0, 1):
        half[y == c] = np.arange(int((y == c).sum())) % 2 == 0
    usual = [texts[k] for k in np.flatnonzero(half & (y == 0)).tolist()]
    ordinary = Sizes(_dictionary([p for t in usual for p in windows(t)], ORDINARY))
    common = [p for t in usual[:COMMON] for p in windows(t)]
    chosen = relabelled([texts[k] for k in np.flatnonzero(half & (y == 1)).tolist()], common, ordinary)
    model = Model([Sizes(_dictionary(c, DICTIONARY) + ordinary.content) for c in chosen if c], ordinary, np.zeros(6), np.zeros(5), np.ones(5))
    if not model.toxic:
        return fit([], [], share)
    rest = np.flatnonzero(~half) if 0 < y[~half].sum() < (~half).sum() else np.arange(len(y))
    x = np.array([features(model.savings(windows(texts[k]))) for k in rest.tolist()])
    model.mean, model.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    model.weights = _logistic((x - model.mean) / model.scale, y[rest])
    drawn = y[rest].mean()
    model.weights[-1] += np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)) if 0 < share < 1 else 0.0
    return model


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` rows of each class that aren't held out."""
    known = labels.select(F.col(id_col), F.col("toxic").cast("int").alias("y")).where(~held_out(id_col) & F.col("y").isin(0, 1))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64(F.col(id_col))
    texts = docs.select(F.col(id_col), F.col(f"`{text_col}`").cast("string").alias("text")).where(F.octet_length("text") <= SAMPLE_BYTES)
    rows = []
    for y in (0, 1):
        ids = known.where(F.col("y") == y).orderBy(order, id_col).limit(2 * sample).select(id_col)
        rows += [(r["text"], y) for r in texts.join(F.broadcast(ids), id_col).orderBy(order, id_col).limit(sample).collect()]
    total = sum(counts.values())
    return fit([t for t, _ in rows], [y for _, y in rows], counts.get(1, 0) / total if total else 0.0)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """`docs` and `score`, 0 to 1; without `keep_text` the text is left out."""
    limit_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = other_columns(docs, text_col, "score")
    frame = docs.select(F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in others)).alias("rest"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = T.StructType([frame.schema["rest"], *([frame.schema["text"]] if keep_text else []), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + keep_text], pa.array(shared.value.scores(texts), pa.float64())], names=out.names)

    names = [c for c in docs.columns if c in others or (keep_text and c.lower() == text_col.lower())]
    return frame.mapInArrow(run, out).select(*((F.col("rest").getField(c) if c in others else F.col("text")).alias(c) for c in names), "score")


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, keep_text=False).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
