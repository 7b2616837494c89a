"""Quality rules with an isolation forest on rule statistics.

Documents with few words, or mostly of repeated windows, fail outright. For the rest, forests of random splits are grown
on the statistics of a bounded sample of labelled rows; documents with short mean path lengths are anomalous. Where many
documents share a fault they hide each other in a large sample of all statistics, so forests of several groups of
statistics and of small and large samples are grown on one half of the rows; the other half calibrates each one's cut
between anomalous and kept, and tells which forest finds most at the asked share of good rows kept.

Edge cases: null and empty texts have no words and fail. With fewer than ``least`` (8) labelled rows of 20 words or more
only the outright rules decide. Without labels of both classes the cut is the sample's 99th percentile of anomaly, and equal
values at the cut are kept. Very long texts are measured in one pass. Repeated rows and null ids are judged each. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Of the features below: share of symbols, capitals, other marks, duplicate lines, repeated words; mean word; lines.
N_FEATURES = 8


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of 8 that the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    # Pairs of ids are numbered densely three times: windows of 2, 4 and 8 words, without collisions.
    for step in (1, 2, 4):
        pair = ids[:-step] * (ids.max() + 1) + ids[step:]
        ids = np.unique(pair, return_inverse=True)[1]
    hit = np.bincount(ids)[ids] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(hit), 1)
    np.add.at(edge, np.flatnonzero(hit) + WINDOW, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts of ``STATS``, and the forest's features."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    blank = len(raw) - len(raw.translate(None, b" \t\n\x0b\f\r"))
    chars = len(text) - blank
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    capitals = len(raw) - len(raw.translate(None, common.UPPER.encode()))
    marks = len(raw) - len(raw.translate(None, b"!?;:=+_~^@/\\()[]{}\"'"))
    digits = len(raw) - len(raw.translate(None, b"0123456789"))
    c, m = max(chars, 1), max(n, 1)
    return [n, chars, symbols, dup, repeat], [symbols / c, capitals / c, marks / c, digits / c, dup / max(len(lines), 1), repeat / m, chars / m, np.log1p(symbols / m)]


class IsolationForest:
    def __init__(self, x: np.ndarray, trees: int = 100, size: int = 256, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        self.depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
        self.norm = self._mean_path(size)
        self.trees = [self._grow(x[rng.choice(len(x), size, replace=False)], rng) for _ in range(trees)]

    @staticmethod
    def _mean_path(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, x: np.ndarray, rng):
        """Arrays of a complete binary tree: feature (-1 in a leaf), split, path length."""
        total = 2 ** (self.depth + 1) - 1
        feature, split, path = np.full(total, -1), np.zeros(total), np.zeros(total)
        stack = [(0, x, 0)]
        while stack:
            at, rows, depth = stack.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) else []
            if depth == self.depth or len(rows) < 2 or not len(spread):
                path[at] = depth + self._mean_path(len(rows))
                continue
            f = int(rng.choice(spread))
            feature[at], split[at] = f, rng.uniform(rows[:, f].min(), rows[:, f].max())
            left = rows[:, f] < split[at]
            stack += [(2 * at + 1, rows[left], depth + 1), (2 * at + 2, rows[~left], depth + 1)]
        return feature, split, path

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """From 0 to 1; near 1 for documents that few splits isolate."""
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, split, path in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[rows, f] >= split[at]))
            total += path[at]
        return 2.0 ** (-total / len(self.trees) / max(self.norm, 1e-9))


class Verdict:
    """Forest and cut. The cut is the one with the best balanced accuracy among those that keep the asked share of good rows."""

    #: Statistics of a forest, by their places: symbols, symbols and word length, repeats, all.
    GROUPS = ((0, 7), (0, 6, 7), (4, 5), tuple(range(N_FEATURES)))
    SIZES = (32, 256)

    def __init__(self, x: np.ndarray, labels: np.ndarray, keep_good: float, seed: int = 19, least: int = 8):
        self.forest, self.columns, self.cut = None, list(range(N_FEATURES)), 2.0
        if len(x) < least:
            return
        if len(np.unique(labels)) < 2:
            self.forest = IsolationForest(x)
            self.cut = float(np.quantile(self.forest.anomaly(x), 0.99)) + 1e-9
            return
        order, best = np.random.default_rng(seed).permutation(len(x)), (-1.0,)
        grow, check = order[: len(x) // 2], order[len(x) // 2 :]
        if len(np.unique(labels[check])) < 2:
            grow = check = order
        for group in self.GROUPS:
            for size in self.SIZES:
                columns = list(group)
                forest = IsolationForest(x[grow][:, columns], size=size)
                accuracy, cut = self._cut(forest.anomaly(x[check][:, columns]), labels[check], keep_good)
                if accuracy > best[0]:
                    best = (accuracy, forest, columns, cut)
        _, self.forest, self.columns, self.cut = best

    @staticmethod
    def _cut(a: np.ndarray, labels: np.ndarray, keep_good: float) -> tuple[float, float]:
        good, bad = np.sort(a[labels == 1]), a[labels == 0]
        least = good[min(len(good) - 1, int(np.ceil(keep_good * len(good))) - 1)] + 1e-9
        cuts = [c for c in np.unique(np.round(a, 6)) if c >= least] or [least]
        return max(((good < c).mean() + (bad >= c).mean(), float(c)) for c in cuts)

    def keeps(self, x: np.ndarray) -> np.ndarray:
        return np.ones(len(x), bool) if self.forest is None else self.forest.anomaly(x[:, self.columns]) < self.cut


def fit(docs: DataFrame, labels: DataFrame, sample: int = 3000, keep_good: float = 0.995, least: int = 8) -> Verdict:
    """Texts are measured where they are; only numbers come to the driver."""
    from .quality_classifier import labelled

    def measured(batches):
        for batch in batches:
            for rows, texts in common.texts_of(batch):
                each = [statistics(t) for t in texts]
                long = pa.array([s[0] >= 20 and 100 * s[4] <= 30 * s[0] for s, _ in each])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([f for _, f in each], pa.list_(pa.float64()))], names=["y", "f"]).filter(long)

    rows = common.sampled_rows(docs, labelled(labels), sample)
    got = rows.select("y", "text").mapInArrow(measured, "y int, f array<double>").collect()
    got = sorted((tuple(r.f), r.y) for r in got)
    return Verdict(np.array([f for f, _ in got]).reshape(-1, N_FEATURES), np.array([y for _, y in got]), keep_good, least=least)


def judge(docs: DataFrame, labels: DataFrame, sample: int = 3000, keep_good: float = 0.995, least: int = 8) -> DataFrame:
    """doc_id, the statistics, base_failed, kept for every row. ``sample`` bounds the labelled rows of the fit, and
    with fewer than ``least`` of them there is no forest."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, keep_good, least))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(k, T.LongType()) for k in STATS), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])

    def judged(batches):
        for batch in batches:
            for rows, texts in common.texts_of(batch):
                each = [statistics(t) for t in texts]
                s = np.array([x for x, _ in each], np.int64)
                failed = (s[:, 0] < 20) | (100 * s[:, 4] > 30 * s[:, 0])
                kept = ~failed & model.value.keeps(np.array([f for _, f in each]))
                yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(s[:, i]) for i in range(len(STATS))), pa.array(failed), pa.array(kept)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(judged, schema)
