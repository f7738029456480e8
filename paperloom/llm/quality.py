"""Quality classifier by compression.

Two zstandard dictionaries are built, from texts labelled good and from texts labelled bad. A
text is compressed with either; the difference of the two sizes, divided by their sum, says
which dictionary knows it better. A logistic curve, fitted on labelled texts that neither
dictionary has seen, turns that difference (with the size itself in proportion to the text,
which tells repetition) into the probability of label 1.

The fit uses at most ``sample`` labelled ids of each class, those with the smallest hashes, with one text
each (of an id's texts the one with the smallest hash) of ``SAMPLE_BYTES`` at most. These bounds hold for the fit alone:
every text is scored, whole, whatever its length.

Defined results: null and empty texts, and all texts if no class can be learnt, get the share
of label 1 among the labelled rows (0.5 without any). Rows with conflicting labels of one id are
not learnt from. A repeated row gets a repeated result; an empty table gives an empty result; further columns play no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Bound of the labelled texts of a class that the driver fits on, and of the bytes of one of them.
SAMPLE, SAMPLE_BYTES = 1500, 65536
DICT_BYTES, LEVEL = 112_640, 3
#: Score from which a text counts as label 1.
CUT = 0.3


@dataclass
class QualityModel:
    good: bytes
    bad: bytes
    weights: list[float]
    prior: float

    def sizer(self):
        """A function of a text's bytes: sizes under the good and the bad dictionary."""
        made = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        return lambda raw: (len(made[0].compress(raw)), len(made[1].compress(raw)))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.good:
            return np.full(len(texts), self.prior)
        size = self.sizer()
        raws = [(t or "").encode("utf-8", "replace") for t in texts]
        x = np.array([_features(len(r), *size(r)) if r else (0.0,) * 5 for r in raws]).reshape(-1, 5)
        p = 1 / (1 + np.exp(-np.clip(x @ np.array(self.weights), -30, 30)))
        return np.where([bool(r) for r in raws], p, self.prior)


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _features(n: int, good: int, bad: int) -> tuple[float, ...]:
    """Bias; normalised difference; the same for longer texts; size in proportion to the text; log length."""
    diff = (bad - good) / (bad + good)
    return 1.0, 10 * diff, diff * math.log1p(n), good / n, math.log1p(n) / 10


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> QualityModel:
    """Two thirds of each class make its dictionary; the others fit the curve."""
    rows = [(t.encode("utf-8", "replace"), y) for t, y in zip(texts, labels, strict=True) if t]
    prior = prior if prior is not None else (sum(labels) / len(labels) if labels else 0.5)
    by = {y: [r for r, z in rows if z == y] for y in (0, 1)}
    if min(map(len, by.values())) < 12:
        return QualityModel(b"", b"", [], float(prior))
    made = {y: _train([r for i, r in enumerate(x) if i % 3]) for y, x in by.items()}
    model = QualityModel(made[1], made[0], [], float(prior))
    size = model.sizer()
    rest = [(r, y) for y, x in by.items() for i, r in enumerate(x) if i % 3 == 0]
    x = np.array([_features(len(r), *size(r)) for r, _ in rest])
    y = np.array([y for _, y in rest], dtype=float)
    # the sample holds as many of either class as it finds; weights give them their shares back
    share = np.where(y == 1, prior / max(y.mean(), 1e-9), (1 - prior) / max(1 - y.mean(), 1e-9))
    model.weights = _logistic(x, y, share).tolist()
    return model


def _train(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, k=256, d=8).as_bytes()
    except zstandard.ZstdError:  # too little to choose from: the texts themselves
        return b"".join(samples)[-DICT_BYTES:]


def _logistic(x: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float = 0.05, steps: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * w
        hess = (x * (share * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_on(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> QualityModel:
    """Fits on labelled rows outside the held-out fold, ``sample`` of each class at most."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("y"))
    known = known.where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").drop("y2")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    prior = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where((F.octet_length("text") > 0) & (F.octet_length("text") <= SAMPLE_BYTES))
    chosen = [known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * sample rows at most
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text")
    got = texts.join(few, "id").groupBy("id").agg(one, F.min("y").alias("y")).collect()  # a row for each chosen id
    rows = sorted(got, key=lambda r: (r["id"] * 0x9E3779B97F4A7C15 % 2**64, r["id"]))
    return fit([r["text"] for r in rows], [r["y"] for r in rows], prior)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; text alone enters the score."""

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame.drop(columns=["text"])
            out["score"] = model.scores(frame["text"].tolist())
            yield out

    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("key"), "text")
    rows = rows.mapInPandas(scored, "key string, score double")
    doc_id = F.col("key").cast("long")
    return rows.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
