"""Quality classifier: a generalised additive model with pairwise interactions, grown by cyclic boosting of shallow trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, table
from .textstats import base_counts, line_measures

#: Labelled documents that the model is fitted on at most.
SAMPLE_DOCS = 12_000
#: Share of held-out documents: those whose crc32(doc_id) modulo FOLDS is HELD.
FOLDS, HELD = 4, 2
ACCEPT = 0.7
BINS, PAIR_BINS, PAIRS = 32, 8, 6
FEATURES = (
    "log_words", "word_length", "symbols", "pipes", "capitals", "marks", "distinct", "same_as_before", "repeated_windows", "repeated_lines",
    "line_words", "line_ends", "digits", "bad_lines", "letters",
)


def features(text: str) -> list[float]:
    """The measures of a text, in the order of FEATURES; all 0 for a text without words."""
    n, chars, symbols, again, repeated = base_counts(text)
    if not n:
        return [0.0] * len(FEATURES)
    words = text.split() or [text]
    m = len(words)
    lines = line_measures(text) or [(1.0, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    each = np.array(lines)
    weight = each[:, 0] / each[:, 0].sum()
    letters = sum(map(str.isalpha, words))
    same = sum(1 for a, b in zip(words, words[1:]) if a == b)
    bad = (each[:, 1] > 0.5) | (each[:, 2] > 0.6) | ((each[:, 3] < 0.3) & (each[:, 0] > 8)) | (each[:, 8] > 0)
    return [
        float(np.log1p(n)), chars / n, symbols / n, text.count("|") / n, float(weight @ each[:, 2]), text.count("!") / n, len(set(words)) / m, same / m,
        repeated / n, again / len(lines), float(np.log1p(m / len(lines))), float(weight @ each[:, 7]), float(weight @ each[:, 6]), float(weight @ bad), letters / m,
    ]


class AdditiveModel:
    """Lookup tables: one over the bins of each feature, and one over the coarse bins of each chosen pair."""

    def __init__(self, edges: list[np.ndarray], coarse: list[np.ndarray], bias: float):
        self.edges, self.coarse, self.bias = edges, coarse, bias
        self.single = [np.zeros(len(e) + 1) for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for each row of measures."""
        fine, coarse = self.bins(x, self.edges), self.bins(x, self.coarse)
        total = np.full(len(x), self.bias)
        for k, values in enumerate(self.single):
            total += values[fine[:, k]]
        for (a, b), values in self.pairs.items():
            total += values[coarse[:, a], coarse[:, b]]
        return 1 / (1 + np.exp(-total))


def _cut(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, int]:
    """The gain and place of the best split of a histogram; (0, 0) if none has `least` weight on both sides."""
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    gt, wt = gradient.sum(), weight.sum()
    ok = (w >= least) & (wt - w >= least)
    if not ok.any():
        return 0.0, 0
    gain = np.where(ok, g * g / np.maximum(w, 1e-9) + (gt - g) ** 2 / np.maximum(wt - w, 1e-9) - gt * gt / max(wt, 1e-9), -1.0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def _tree(gradient: np.ndarray, weight: np.ndarray, least: float) -> np.ndarray:
    """The Newton steps of a tree with up to four leaves over the bins of one feature."""
    step = np.zeros(len(gradient))
    parts = [(0, len(gradient))]
    for _ in range(2):
        nxt = []
        for a, b in parts:
            gain, at = _cut(gradient[a:b], weight[a:b], least)
            nxt += [(a, a + at), (a + at, b)] if gain > 0 and at else [(a, b)]
        parts = nxt
    for a, b in parts:
        step[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + 1.0)
    return step


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """The gain and Newton steps of a tree that splits a two-way table once each way."""
    best, found = 0.0, np.zeros_like(gradient)
    for g, w, turn in ((gradient, weight, False), (gradient.T, weight.T, True)):
        for at in range(1, len(g)):
            step, gain = np.zeros_like(g), -(g.sum() ** 2) / max(w.sum(), 1e-9)
            for part in (slice(0, at), slice(at, None)):
                _, cut = _cut(g[part].sum(axis=0), w[part].sum(axis=0), least)
                for side in (slice(0, cut), slice(cut, None)):
                    gs, ws = g[part, side].sum(), w[part, side].sum()
                    step[part, side] = gs / (ws + 1.0)
                    gain += gs * gs / max(ws, 1e-9)
            if gain > best:
                best, found = gain, step.T if turn else step
    return best, found


def fit_model(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, least: float = 2.0) -> AdditiveModel:
    """Cyclic boosting: round after round, each feature in turn gets a small step of a shallow tree; then the pairs with
    the largest gain on the remaining error get theirs. With no rows, or one label only, the score is the prior's."""
    n = len(y)
    prior = (y.sum() + 0.5) / (n + 1.0)
    quantiles = lambda k, bins: np.unique(np.quantile(x[:, k], np.arange(1, bins) / bins)) if n else np.zeros(0)
    both = lambda k, bins: np.unique(np.concatenate([quantiles(k, bins), *[np.quantile(x[y == c, k], np.arange(1, bins // 2) / (bins // 2)) for c in (0, 1) if (y == c).any()]]))
    model = AdditiveModel([both(k, BINS) for k in range(x.shape[1])], [both(k, PAIR_BINS) for k in range(x.shape[1])], float(np.log(prior / (1 - prior))))
    if not n or y.min() == y.max():
        return model
    fine, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    total = np.full(n, model.bias)
    for _ in range(rounds):
        for k, values in enumerate(model.single):
            p = 1 / (1 + np.exp(-total))
            step = rate * _tree(np.bincount(fine[:, k], y - p, len(values)), np.bincount(fine[:, k], p * (1 - p), len(values)), least)
            values += step
            total += step[fine[:, k]]
    shapes = {(a, b): (len(model.coarse[a]) + 1, len(model.coarse[b]) + 1) for a in range(x.shape[1]) for b in range(a)}
    flat = {q: coarse[:, q[0]] * s[1] + coarse[:, q[1]] for q, s in shapes.items()}

    def grow(q: tuple[int, int]) -> tuple[float, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        size = shapes[q][0] * shapes[q][1]
        return _pair_tree(np.bincount(flat[q], y - p, size).reshape(shapes[q]), np.bincount(flat[q], p * (1 - p), size).reshape(shapes[q]), least)

    chosen = sorted(shapes, key=lambda q: (-grow(q)[0], q))[:PAIRS]
    model.pairs = {q: np.zeros(shapes[q]) for q in chosen}
    for _ in range(rounds // 4):
        for q in chosen:
            step = rate * grow(q)[1]
            model.pairs[q] += step
            total += step.ravel()[flat[q]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.list_(pa.float64())), b.column("label")], ["doc_id", "x", "label"])


def known_labels(labels: DataFrame, column: str) -> DataFrame:
    """One (doc_id, label) per document with a label of 0 or 1; of contradicting rows the larger label counts."""
    rows = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return rows.groupBy("doc_id").agg(F.max("label").alias("label"))


def fit_on(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """A model fitted on a bounded sample (SAMPLE_DOCS) of the labelled documents that aren't held out."""
    known = known_labels(labels, "quality").filter(crc_mod("doc_id", FOLDS) != HELD)
    known = F.broadcast(bounded_sample(known, "doc_id", SAMPLE_DOCS))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(known, "doc_id")
    found = rows.select("doc_id", "text", "label").mapInArrow(_features, "doc_id long, x array<double>, label int").toPandas().sort_values("doc_id", kind="stable")
    return fit_model(np.array(found["x"].tolist(), float).reshape(-1, len(FEATURES)), found["label"].to_numpy(float))


def _scorer(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column("text")], float).reshape(-1, len(FEATURES))
            place = b.schema.get_field_index("text")
            kept = [b.column(k) for k in range(b.num_columns) if k != place]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(x))], [*(c for c in b.schema.names if c != "text"), "score"])

    return run


def score_documents(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    Null and empty texts are scored as texts without words. A null doc_id is not held out. Repeated rows get a row
    each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def _accepts(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column("text")], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= ACCEPT))

    return run


def keep_good(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """The rows of docs that the model accepts, unchanged."""
    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(_accepts(model), docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")))
