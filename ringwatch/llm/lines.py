"""Quality rules by line sequence labelling: a linear-chain conditional random field marks content and boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, table
from .textstats import LINE_MEASURES, base_counts, line_measures

#: Labelled documents, and lines of each, that the field is fitted on at most.
SAMPLE_DOCS, SAMPLE_LINES = 2_000, 64
#: Lines of a longer text are sampled in stretches of so many, chosen by a hash over the whole text.
STRETCH = 16
#: Least share of a document's words in content lines.
LEAST_CONTENT = 0.3
#: Edges between the bins of each measure of a line.
EDGES = {
    "words": (2, 4, 8, 16, 32), "symbols": (0.05, 0.2, 0.5, 0.9, 1.5), "upper": (0.1, 0.3, 0.6, 0.9), "unique": (0.15, 0.3, 0.5, 0.7, 0.9),
    "length": (3.5, 5, 6.5, 8, 10, 14), "marks": (0.1, 0.3, 0.6, 1.0), "digits": (0.05, 0.2, 0.5), "end": (0.5,), "again": (0.5,),
}
_EDGES = [np.array(EDGES[m]) for m in LINE_MEASURES]
_FIRST = np.r_[0, np.cumsum([len(e) + 1 for e in _EDGES])]
FEATURES = int(_FIRST[-1])


def line_bins(measures: np.ndarray) -> np.ndarray:
    """The feature of each measure (columns) that holds for each line (rows)."""
    return np.stack([_FIRST[k] + np.searchsorted(e, measures[:, k], side="right") for k, e in enumerate(_EDGES)], axis=1)


class LineField:
    """Weights of a two-label chain (0 boilerplate, 1 content): one per feature, for the content label, and one per
    pair of neighbouring labels."""

    def __init__(self, weights: np.ndarray, bias: float, step: np.ndarray):
        self.weights, self.bias, self.step = weights, bias, step

    def scores(self, measures: np.ndarray) -> np.ndarray:
        """The content score of each line."""
        return self.bias + self.weights[line_bins(measures)].sum(axis=1) if len(measures) else np.zeros(0)

    def viterbi(self, scores: list[float]) -> list[int]:
        """The best labels of one document's lines."""
        (s00, s01), (s10, s11) = self.step.tolist()
        a, b, back = 0.0, 0.0, []
        for k, s in enumerate(scores):
            if k:
                from0, from1 = a + s00 < b + s10, a + s01 < b + s11
                back.append((from0, from1))
                a, b = (b + s10 if from0 else a + s00), (b + s11 if from1 else a + s01) + s
            else:
                b = s
        if not scores:
            return []
        out = [int(b >= a)]
        for pair in reversed(back):
            out.append(int(pair[out[-1]]))
        return out[::-1]


def fit_field(lines: list[np.ndarray], good: np.ndarray, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> LineField:
    """Maximum likelihood by gradient ascent over padded sequences of lines (one array of measures a document).

    Lines start with their document's label; once the weights have settled, lines of rejected documents that look
    like content get the content label, and the weights are fitted again. Without documents of both labels all
    weights are 0, so every line is content.
    """
    field = LineField(np.zeros(FEATURES), 0.0, np.zeros((2, 2)))
    pick = [k for k, x in enumerate(lines) if len(x)]
    lines, good = [lines[k] for k in pick], good[pick]
    if not len(good) or good.min() == good.max():
        return field
    size = np.array([len(x) for x in lines])
    n, t = len(lines), int(size.max())
    there = np.arange(t)[None, :] < size[:, None]
    bins = np.zeros((n, t, len(_EDGES)), np.int64)
    bins[there] = line_bins(np.concatenate(lines))
    label = np.repeat(good[:, None].astype(np.int64), t, axis=1)
    each = np.where(good == 1, 0.5 / (good == 1).sum(), 0.5 / (good == 0).sum()) / size  # both labels weigh the same
    for part in range(2):
        for _ in range(rounds):
            score = np.zeros((n, t, 2))
            score[:, :, 1] = field.bias + field.weights[bins].sum(axis=2)
            alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
            alpha[:, 0] = score[:, 0]
            for k in range(1, t):
                alpha[:, k] = score[:, k] + np.logaddexp(alpha[:, k - 1, :1] + field.step[0], alpha[:, k - 1, 1:] + field.step[1])
            for k in range(t - 2, -1, -1):
                follow = (beta[:, k + 1] + score[:, k + 1]) * there[:, k + 1, None]
                ways = np.logaddexp(field.step[:, 0] + follow[:, :1], field.step[:, 1] + follow[:, 1:])
                beta[:, k] = np.where(there[:, k + 1, None], ways, 0.0)
            whole = np.logaddexp.reduce(alpha[:, 0] + beta[:, 0], axis=1)
            content = np.exp(alpha[:, :, 1] + beta[:, :, 1] - whole[:, None])
            off = np.where(there, label - content, 0.0) * each[:, None]
            gradient = np.bincount(bins[there].ravel(), np.repeat(off[there], len(_EDGES)), FEATURES)
            moves = np.zeros((2, 2))
            if t > 1:
                both = alpha[:, :-1, :, None] + field.step + (score + beta)[:, 1:, None, :] - whole[:, None, None, None]
                expect = np.exp(np.minimum(both, 0.0)) * (there[:, 1:] * each[:, None])[:, :, None, None]
                moves = -expect.sum(axis=(0, 1))
                np.add.at(moves, (label[:, :-1][there[:, 1:]], label[:, 1:][there[:, 1:]]), np.repeat(each, np.maximum(size - 1, 0)))
            field.weights += rate * 8 * (gradient - decay * field.weights)
            field.bias += rate * 8 * off.sum()
            field.step += rate * 4 * (moves - decay * field.step)
        if part == 0:
            label = np.where((label == 0) & (field.bias + field.weights[bins].sum(axis=2) > 0), 1, label)
    return field


def sample_lines(text: str) -> list:
    """The measures of a text's lines, or of SAMPLE_LINES of them at most: whole stretches, each as likely as another."""
    found = line_measures(text)
    if len(found) <= SAMPLE_LINES:
        return found
    key = xxhash.xxh64_hexdigest(text.encode("utf-8", "surrogatepass"))
    starts = sorted(range(0, len(found), STRETCH), key=lambda k: xxhash.xxh64_intdigest(f"{key}|{k}"))
    return [m for k in sorted(starts[: SAMPLE_LINES // STRETCH]) for m in found[k : k + STRETCH]]


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[list(m) for m in sample_lines(t or "")] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.list_(pa.float64()))), b.column("good")], ["lines", "good"])


def fit_on(docs: DataFrame, labels: DataFrame) -> LineField:
    """A field fitted on a bounded sample of labelled documents (SAMPLE_DOCS documents, SAMPLE_LINES lines of each)."""
    known = labels.select("doc_id", F.col("quality").alias("good")).filter("doc_id is not null and good in (0, 1)").groupBy("doc_id").agg(F.max("good").alias("good"))
    known = F.broadcast(bounded_sample(known, "doc_id", SAMPLE_DOCS))
    rows = docs.select("doc_id", "text").join(known, "doc_id").select("text", F.col("good").cast("int"))
    found = rows.mapInArrow(_measures, "lines array<array<double>>, good int").toPandas()
    lines = [np.array([list(m) for m in x], float).reshape(-1, len(LINE_MEASURES)) for x in found["lines"]]
    order = sorted(range(len(lines)), key=lambda k: (found["good"][k], lines[k].tobytes()))
    return fit_field([lines[k] for k in order], found["good"].to_numpy()[order])


def content_share(field: LineField, text: str) -> float:
    """The share of the text's words in lines that Viterbi decoding marks as content; 0 for a text without words."""
    measures = np.array(line_measures(text)).reshape(-1, len(LINE_MEASURES))
    if not len(measures):
        return 0.0
    marked = np.array(field.viterbi(field.scores(measures).tolist()))
    return float((measures[:, 0] * marked).sum() / measures[:, 0].sum())


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _judge(field: LineField):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = np.zeros((b.num_rows, 5), np.int64)
            failed, kept, shares = [], [], []
            for row, t in enumerate(b.column("text")):
                text = t.as_py() or ""
                counts[row] = c = base_counts(text)
                share = content_share(field, text)
                failed.append(c[0] < 20 or 100 * c[4] > 30 * c[0])
                kept.append(not failed[-1] and share >= LEAST_CONTENT)
                shares.append(share)
            columns = [b.column("doc_id"), *(pa.array(counts[:, k]) for k in range(5)), pa.array(failed), pa.array(kept), pa.array(shares)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COLUMNS, "base_failed", "kept", "content_share"])

    return run


def judge_documents(docs: DataFrame, field: LineField) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share).

    One row for every row of docs (doc_id, text). A null text has no words and fails. Whole texts are read, however
    long. Rows are independent, so repeated rows and null doc_ids pass through; other columns are ignored.
    """
    kinds = "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", base_failed boolean, kept boolean, content_share double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_judge(field), kinds)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_documents(docs, fit_on(docs, table(spark, sf_dir, "labels")))
