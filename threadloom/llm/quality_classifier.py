"""Quality classification by naive Bayes support vectors.

Indicators of hashed byte n-grams are scaled by the classes' log-count ratios; a linear model with hinge loss is fitted
on them by dual coordinate descent, and its margins are turned into probabilities on labelled rows left out of the fit.

Edge cases: null text is empty and gets the score of the intercept. Null or conflicting labels are not learned from;
with labels of fewer than two classes every score is that class's (or 0.5 with none). Very long texts are scored whole, in
pieces of bounded size. Repeated rows and null ids are scored each. An empty table gives no rows. Extra columns may have
any names; a kept one that is named like a result is returned with ``_in`` added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS, ORDERS = 15, (1, 2, 3)


def marked(raw: bytes) -> bytes:
    """The text, then a byte for each word (1: repeats the word before, 2: not) and each line (3: seen before, 4: not);
    n-grams of those are features like any others."""
    words, lines = raw.split(), raw.split(b"\n")
    again = bytes([1 if a == b else 2 for a, b in zip(words, words[1:])])
    twice, seen = bytearray(), set()
    for line in lines:
        twice.append(3 if line in seen and line.strip() else 4)
        seen.add(line)
    return raw + b"\0" + again + b"\0" + twice


def indicators(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 for each text: which hashed byte n-grams it has."""
    raw = [marked(t.encode("utf-8", "replace")) for t in texts]
    owner = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    out = np.zeros((len(raw), 1 << BITS), np.uint8)
    for n in ORDERS:
        if len(data) < n:
            break
        gram = np.full(len(data) - n + 1, n, np.uint32)
        for i in range(n):
            gram = gram * np.uint32(0x01000193) ^ data[i : len(data) - n + 1 + i]
        gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
        first, last = owner[: len(gram)], owner[n - 1 :]
        whole = first == last
        out[first[whole], gram[whole]] = 1
    return out


class NBSVM:
    def __init__(self, texts: list[str], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, epochs: int = 30, mix: float = 0.5, seed: int = 5):
        self.base, self.w, self.b, self.slope, self.shift = float(labels.mean()) if len(labels) else 0.5, None, 0.0, 1.0, 0.0
        if len(np.unique(labels)) < 2:
            return
        x = np.concatenate([indicators(texts[i : i + 64]) for i in range(0, len(texts), 64)])
        order = np.random.default_rng(seed).permutation(len(labels))
        held, fit = order[: len(order) // 4], order[len(order) // 4 :]
        if len(np.unique(labels[fit])) < 2:
            held, fit = order, order
        p = smoothing + x[fit][labels[fit] == 1].sum(axis=0, dtype=np.float64)
        q = smoothing + x[fit][labels[fit] == 0].sum(axis=0, dtype=np.float64)
        self.ratio = np.log((p / p.sum()) / (q / q.sum()))
        w, self.b = self._descend(x, fit, np.where(labels == 1, 1.0, -1.0), cost, epochs, seed)
        w = mix * w + (1 - mix) * np.abs(w).mean()
        self.w = (w * self.ratio).astype(np.float32)
        self._calibrate(x[held] @ self.w + self.b, labels[held])

    def _descend(self, x, rows, y, cost, epochs, seed) -> tuple[np.ndarray, float]:
        """Dual coordinate descent for the L1 hinge loss; classes weigh the same; the intercept is one more feature."""
        at = {i: np.flatnonzero(x[i]) for i in rows}
        share = {s: len(rows) / 2 / max(1, (y[rows] == s).sum()) for s in (-1.0, 1.0)}
        norm = {i: float((self.ratio[at[i]] ** 2).sum()) + 1 for i in rows}
        w, b, alpha, rng = np.zeros(x.shape[1]), 0.0, dict.fromkeys(rows, 0.0), np.random.default_rng(seed)
        for _ in range(epochs):
            most = 0.0
            for i in rng.permutation(rows):
                r = self.ratio[at[i]]
                slope = y[i] * (w[at[i]] @ r + b) - 1
                new = min(max(alpha[i] - slope / norm[i], 0.0), cost * share[y[i]])
                step = (new - alpha[i]) * y[i]
                if step:
                    w[at[i]] += step * r
                    b += step
                    most = max(most, abs(step) * norm[i])
                    alpha[i] = new
            if most < 1e-3:
                break
        return w, b

    def _calibrate(self, margin: np.ndarray, labels: np.ndarray) -> None:
        """Logistic curve over the margins, with smoothed targets, by Newton steps."""
        scale = float(np.abs(margin).mean()) or 1.0
        m, a, c = margin / scale, 1.0, 0.0
        n1, n0 = (labels == 1).sum(), (labels == 0).sum()
        target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a * m + c, -30, 30)))
            g = np.array([((p - target) * m).sum() + 1e-3 * a, (p - target).sum()])
            v = p * (1 - p)
            h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-6]])
            d = np.clip(np.linalg.solve(h, g), -2, 2)
            a, c = a - d[0], c - d[1]
        self.slope, self.shift = a / scale, c

    def score(self, texts: list[str]) -> np.ndarray:
        if self.w is None:
            return np.full(len(texts), self.base)
        out = np.empty(len(texts))
        for i in range(0, len(texts), 64):
            out[i : i + 64] = indicators(texts[i : i + 64]).astype(np.float32) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.shift, -30, 30)))


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, part, y) of the labels that may be learned from: known, not contradictory, not in the held-out fold. All are of
    one part."""
    return (
        labels.where(F.col("quality").isNotNull() & (common.fold_of(F.col("doc_id"), 5) != 0))
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("y"), F.max("quality").alias("y1"))
        .where("y = y1")
        .select("doc_id", F.lit(0).alias("part"), "y")
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000) -> NBSVM:
    rows = sorted(common.sampled_rows(docs, labelled(labels), sample).collect(), key=lambda r: str(r.doc_id))
    return NBSVM([r.text or "" for r in rows], np.array([int(r.y) for r in rows], np.int64))


def classify(docs: DataFrame, labels: DataFrame, sample: int = 3000, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (doc_id by default), held_out, score for every row. ``sample`` bounds the labelled rows of the fit."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    keep = keep or ["doc_id"]
    held = F.coalesce(common.fold_of(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    source = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("k"), held, "text")
    names = [name for _, name in common.kept_names(keep, ("held_out", "score"))]
    fields = [T.StructField(n, docs.schema[c].dataType) for n, c in zip(names, keep)]
    schema = T.StructType([*fields, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType())])

    def scored(batches):
        for batch in batches:
            for rows, texts in common.texts_of(batch):
                yield pa.RecordBatch.from_arrays([*rows.column(0).flatten(), rows.column(1), pa.array(model.value.score(texts))], names=schema.names)

    return source.mapInArrow(scored, schema)
