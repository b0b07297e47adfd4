"""Quality classifier: a generalised additive model with pairwise interactions.

Each text becomes a short vector of statistics. Every feature is cut into bins by quantiles of the training rows;
cyclic boosting visits the features in turn and fits a tree of few leaves to the gradient of the log loss over the
feature's bins, so that each feature's trees add up to one lookup table. After that the pairs of features that lower
the loss most get small two-way tables, fitted in the same way to what the main effects leave. A score is the logistic
function of the added table entries, for whole batches by indexing.

The model is fitted on the driver, on SAMPLE_ROWS labelled rows at most: those with the smallest hash of the id. All
statistics of a text cover the whole text. Labels, language, source and id are never features.

Defined results: a null text is empty; empty texts have a score like any other. Labels that are null are ignored, and
of an id's repeated labels the mean decides (0.5 counts as good). Without labelled rows, or with one kind only, the
score is the smoothed share of good labels. Rows are scored one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderkeep.llm.common import map_arrow, prepare, table, texts
from orderkeep.llm.textkernel import chunks

#: The bound on labelled rows that fit the model.
SAMPLE_ROWS = 20_000
FEATURES = ("log_words", "word_bytes", "longest_word", "symbols", "marks", "upper", "digits", "beyond_ascii", "distinct", "repeated", "line_words", "dup_lines", "top_word")

_BYTE = np.arange(256)
_KINDS = np.zeros((6, 256), np.float32)
_KINDS[0, [ord(c) for c in "#*$%&|<>"]] = 1
_KINDS[1, [ord(c) for c in "!?.,;:"]] = 1
_KINDS[2, ord("A") : ord("Z") + 1] = 1
_KINDS[3, ord("0") : ord("9") + 1] = 1
_KINDS[4, 0xC2:] = 1  # leading bytes of code points beyond ASCII
_KIND = np.full(256, 7, np.uint8)
for _k in range(5):
    _KIND[_KINDS[_k] > 0] = _k


def features(items: Sequence[str]) -> np.ndarray:
    """A row of FEATURES for each text."""
    out = np.zeros((len(items), len(FEATURES)), np.float32)
    for at, words in chunks(items, lower=False):
        n = len(words.first) - 1
        kind = _KIND[words.data].astype(np.int64) + 8 * np.repeat(np.arange(n), np.diff(words.begins))
        counts = np.bincount(kind, minlength=8 * n).reshape(n, 8).astype(np.float64)
        sizes = words.ends - words.starts
        windows = words.windows(5)
        newline = np.flatnonzero(words.data == 10)
        line_of = np.searchsorted(newline, words.starts)
        for d in range(n):
            a, b = int(words.first[d]), int(words.first[d + 1])
            m = b - a
            if not m:
                continue
            h, size = np.sort(words.hashes[a:b]), sizes[a:b]
            runs = np.diff(np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))))
            bytes_ = float(size.sum())
            row = out[at + d]
            row[0] = np.log1p(m)
            row[1] = bytes_ / m
            row[2] = size.max()
            row[3] = counts[d, 0] / m
            row[4] = counts[d, 1] / m
            row[5] = counts[d, 2] / bytes_
            row[6] = counts[d, 3] / bytes_
            row[7] = counts[d, 4] / bytes_
            row[8] = len(runs) / m
            row[12] = runs.max() / m
            if m >= 5:
                w = np.sort(windows[a : b - 4])
                row[9] = (w[1:] == w[:-1]).sum() / len(w)
            # a line is known by the sum of its word hashes, each times its place in the line
            lines = line_of[a:b]
            begin = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1])))
            place = np.arange(m) - np.repeat(begin, np.diff(np.append(begin, m)))
            key = np.add.reduceat(words.hashes[a:b] * (2 * place + 1).astype(np.uint64), begin)
            row[10] = m / len(begin)
            row[11] = 1 - len(np.unique(key)) / len(begin)
    return out


@dataclass
class Additive:
    """Lookup tables over binned features. cuts, tables: for each feature; pairs: (feature, feature, cuts, cuts, table)."""

    base: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (cuts, values) in enumerate(zip(self.cuts, self.tables, strict=True)):
            out += values[np.searchsorted(cuts, x[:, j], side="right")]
        for i, j, ci, cj, values in self.pairs:
            out += values[np.searchsorted(ci, x[:, i], side="right"), np.searchsorted(cj, x[:, j], side="right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    inner = np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))
    low = np.unique(x)
    # between two values that occur, so that rounding moves no row
    at = np.searchsorted(low, inner)
    return np.unique([(low[k - 1] + low[k]) / 2 for k in at if 0 < k < len(low)]).astype(np.float32)


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values by bin of a tree of so many leaves, each split the best one, fitted to summed gradients."""
    g, h = np.concatenate(([0.0], np.cumsum(grad))), np.concatenate(([0.0], np.cumsum(hess)))
    worth = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None)
        for k, (a, b) in enumerate(parts):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = worth(a, mid) + worth(mid, b) - worth(a, b)
                m = int(gain.argmax())
                if gain[m] > best[0]:
                    best = (gain[m], (k, int(mid[m])))
        if best[1] is None:
            break
        k, m = best[1]
        a, b = parts[k]
        parts[k : k + 1] = [(a, m), (m, b)]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _grid(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A tree over two features' grid: the best cut of the one, then of either side by the other; and its gain."""
    best: tuple[float, np.ndarray | None] = (0.0, None)
    for turn in (False, True):
        g, h = (grad.T, hess.T) if turn else (grad, hess)
        gc, hc = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
        for cut in range(1, len(g)):
            value, gain = np.zeros_like(g), 0.0
            for rows, gs, hs in ((slice(0, cut), gc[cut - 1], hc[cut - 1]), (slice(cut, None), gc[-1] - gc[cut - 1], hc[-1] - hc[cut - 1])):
                leaf = _tree(gs, hs, 2, ridge)
                value[rows] = leaf
                gain += float((leaf * gs).sum())
            if gain > best[0]:
                best = (gain, value.T if turn else value)
    return (np.zeros_like(grad) if best[1] is None else best[1]), best[0]


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 64, pairs: int = 4, pair_rounds: int = 15, ridge: float = 2.0) -> Additive:
    good = float(y.sum())
    share = (good + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    cuts = [_cuts(x[:, j], bins) if len(x) else np.zeros(0, np.float32) for j in range(x.shape[1])]
    model = Additive(base, cuts, [np.zeros(len(c) + 1) for c in cuts], [])
    if not 0 < good < len(y):
        return model
    code = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    logit = np.full(len(y), base)

    def slope() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, c in enumerate(code):
            grad, hess = slope()
            n = len(model.tables[j])
            step = rate * _tree(np.bincount(c, grad, n), np.bincount(c, hess, n), 3, ridge)
            model.tables[j] += step
            logit += step[c]
    coarse = [_cuts(x[:, j], 8) for j in range(x.shape[1])]
    cell = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(coarse[i]) + 1, len(coarse[j]) + 1)
        grad, hess = slope()
        at = cell[i] * shape[1] + cell[j]
        return np.bincount(at, grad, shape[0] * shape[1]).reshape(shape), np.bincount(at, hess, shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_grid(*sums(i, j), ridge)[1], i, j) for i in range(len(coarse)) for j in range(i)), reverse=True)
    model.pairs = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in gains[:pairs] if gain > 0]
    for _ in range(pair_rounds):
        for i, j, _, _, values in model.pairs:
            step = rate * _grid(*sums(i, j), ridge)[0]
            values += step
            logit += step[cell[i], cell[j]]
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the id as text, modulo 3, is 1 (a null id is held out)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS) -> Additive:
    """The model of the labelled documents that aren't held out; sample_rows bounds what reaches the driver."""
    prepare(docs.sparkSession)
    few = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & ~held_out("id"))
        .groupBy("id")
        .agg(F.avg("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample_rows)
    )
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "id")  # sample_rows rows at most

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(texts(batch))
        return pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(list(x.astype(np.float64)), pa.list_(pa.float64()))], names=["id", "label", "x"])

    got = map_arrow(rows, run, "id long, label double, x array<double>").orderBy(F.xxhash64("id"), "id", "label", F.col("x").cast("string")).limit(sample_rows).collect()
    x = np.array([r.x for r in got], np.float32).reshape(len(got), len(FEATURES))
    return fit(x, np.array([float(r.label >= 0.5) for r in got]))


def score(df: DataFrame, model: Additive, text_col: str = "text", to: str = "score") -> DataFrame:
    """df with its score from 0 to 1 as column `to` (replaced if it exists)."""
    from pyspark.sql import types as T

    prepare(df.sparkSession)
    keep = [c for c in df.columns if c != to]
    rows = df.select(*(F.col(f"`{c}`") for c in keep))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(features(texts(batch, text_col))), pa.float64())], names=[*keep, to])

    return map_arrow(rows, run, T.StructType([*rows.schema.fields, T.StructField(to, T.DoubleType())]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents by a model of the labels that aren't held out. A null id has no remainder: it counts as held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model, to="__score").filter(F.col("__score") >= 0.5).drop("__score")
