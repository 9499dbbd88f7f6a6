"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, crc_mod, discard, materialize, table
from .quality import known_labels

FOLDS, HELD = 5, 0
#: Labelled documents that voters and classifier are fitted on at most; lexicon voters at most; letters of a stem.
SAMPLE_DOCS, VOTERS = 12_000, 300
SHORTEST, LONGEST = 3, 10
#: Occurrences in one text that count as evidence for a stem, so that a text of one repeated word doesn't make a voter.
OFTEN = 3
#: False alarms of a voter cost as much as so many hits when its threshold is chosen.
FALSE_COST = 6
#: Two voters depend on each other from this share of the smaller one's entropy on.
LEAST_SHARED = 0.1
#: Kinds of toxic texts (languages, say) that the label model tells apart at most. A kind starts with so many texts and with
#: this share of the toxic ones at least: smaller ones gather voters that were right by chance.
KINDS, KIND_TEXTS, KIND_SHARE = 12, 5, 0.04
KEPT, CHUNK = 200_000, 256
_WORD = re.compile(r"[^\W\d_]+")
#: Insults that every lexicon holds, besides what the labelled documents teach.
INSULTS = (
    "idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "cretin", "jerk",
    "bastard", "bitch", "asshole", "dumbass", "shit", "fuck", "fucking", "whore", "slut", "retard", "pig", "vermin", "filth", "garbage",
)
#: Pattern voters. Disguised insults (digits or signs for letters, letters spelt apart) and threats.
PATTERNS = {
    "disguised": re.compile(r"\b(?:[i1!]d[i1!][o0]t|m[o0]r[o0]n|stup[i1!]d|l[o0]s[e3]r|[s$]cum|tr[a@4][s$]h|cl[o0]wn|f[u*@]ck|sh[i1!*]t|b[i1!*]tch)", re.I),
    "spelt_apart": re.compile(r"\b(?:i[ .*-]d[ .*-]i[ .*-]o[ .*-]t|m[ .*-]o[ .*-]r[ .*-]o[ .*-]n|s[ .*-]t[ .*-]u[ .*-]p[ .*-]i[ .*-]d|l[ .*-]o[ .*-]s[ .*-]e[ .*-]r)\b", re.I),
    "addressed": re.compile(r"\byou(?:'re| are)?(?: an?| such an?| all)? (?:" + "|".join(INSULTS) + r")s?\b", re.I),
    "threat": re.compile(r"\b(?:kill|hurt|hang|beat) (?:you|yourself|them all)\b|\bgo die\b", re.I),
}
#: A disguised word must really be disguised: the plain spelling is the lexicon's business.
_PLAIN = re.compile(r"[a-z]+", re.I)


def stems_of(word: str) -> list[str]:
    """The word (marked with = at its end) and its beginnings."""
    return [word + "=", *(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1))]


def pattern_hits(text: str) -> list[int]:
    """How often each pattern is found."""
    out = []
    for name, p in PATTERNS.items():
        out.append(sum(1 for m in p.finditer(text) if name != "disguised" or not _PLAIN.fullmatch(m[0])))
    return out


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences of words and stems by label, with documents (n_docs), counted per partition before the shuffle."""
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    docs: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for b in batches:
        for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
            words = Counter(_WORD.findall((text or "").lower()))
            seen[label].update({w: min(n, OFTEN) for w, n in words.items()})
            docs[label].update(words.keys())
    for label in (0, 1):
        total: dict[str, list[int]] = {}
        for w, n in seen[label].items():
            for s in stems_of(w):
                t = total.setdefault(s, [0, 0])
                t[0] += n
                t[1] += docs[label][w]
        keys = list(total)
        for at in range(0, len(keys), 20_000):
            part = keys[at : at + 20_000]
            columns = [pa.array(part, pa.string()), pa.array([label] * len(part), pa.int32()), pa.array([total[k][0] for k in part], pa.int64()), pa.array([total[k][1] for k in part], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["stem", "label", "n", "n_docs"])


def lexicon(sample: DataFrame, most: int = VOTERS) -> list[str]:
    """The fixed insults and the stems whose rate in toxic texts is furthest above that in others, counting each
    occurrence; of nested stems with about the same counts the longest stays."""
    counts = sample.select("text", "label").mapInArrow(_stem_counts, "stem string, label int, n long, n_docs long")
    sums = counts.groupBy("stem").agg(*[F.coalesce(F.sum(F.when(F.col("label") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}") for k in (0, 1) for c in ("n", "n_docs")])
    whole = sample.groupBy("label").agg(F.sum(F.regexp_count("text", F.lit(r"\p{L}+"))).alias("n")).collect()
    words = {r["label"]: float(r["n"] or 0) + 1 for r in whole}
    found = [f"{w}=" for w in INSULTS]
    if len(words) < 2:
        return found
    expected = F.col("n0") / words[0] * words[1]
    gain = F.col("n1") * F.log((F.col("n1") + 1) / (expected + 1))
    rows = sums.filter("n_docs1 >= 4").withColumn("gain", gain).filter((F.col("n1") > 4 * expected) & (F.col("gain") > 8))
    rows = rows.orderBy(F.desc("gain"), F.desc(F.length("stem")), "stem").limit(most * 4).collect()
    taken: dict[str, int] = {}
    for r in rows:
        if not any((a.startswith(r["stem"].rstrip("=")) or r["stem"].startswith(a.rstrip("="))) and r["n1"] > 0.9 * n and n > 0.9 * r["n1"] for a, n in taken.items()):
            taken[r["stem"]] = r["n1"]
    return [*found, *[s for s in taken if s not in found]][:most]


class Measurer:
    """Counts lexicon hits: the number of words, and the occurrences of each stem."""

    def __init__(self, stems: list[str]):
        self.number = {s: k for k, s in enumerate(stems)}
        self.n = len(stems)
        self.known: dict[str, tuple[int, ...]] = {}

    def measure(self, texts: list[str]) -> list[tuple[int, Counter, list[int]]]:
        """For each text its words, the hits of each stem and of each pattern."""
        cut = [_WORD.findall(t.lower()) for t in texts]
        every = set().union(*cut)
        if len(self.known) + len(every) > KEPT:
            self.known.clear()
        for w in every - self.known.keys():
            self.known[w] = tuple(k for k in map(self.number.get, stems_of(w)) if k is not None)
        known, out = self.known, []
        for t, words in zip(texts, cut, strict=True):
            hits = Counter()
            for h in map(known.__getitem__, words):
                if h:
                    hits.update(h)
            out.append((len(words), hits, pattern_hits(t)))
        return out


def rates(measured: list[tuple[int, Counter, list[int]]], stems: int) -> np.ndarray:
    """Rows of hits per 100 words (at least 20 words count) for each stem, each pattern, and all of them."""
    x = np.zeros((len(measured), stems + len(PATTERNS) + 1))
    for row, (n, hits, patterns) in enumerate(measured):
        size = max(n, 20)
        for k, c in hits.items():
            x[row, k] = 100.0 * c / size
        x[row, stems:-1] = [100.0 * c / size for c in patterns]
    x[:, -1] = x[:, :-1].max(axis=1, initial=0.0)
    return x


def thresholds(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each column the rate from which a voter says toxic: the one that tells the labels apart best."""
    out = np.zeros(x.shape[1])
    for k in range(x.shape[1]):
        some = x[:, k] > 0
        if not some.any():
            continue
        v, t = x[some, k], y[some]
        order = np.argsort(-v, kind="stable")
        v, t = v[order], t[order]
        good, bad = np.cumsum(t), np.cumsum(1 - t)
        ends = np.r_[v[1:] != v[:-1], True]
        value = np.where(ends, good - FALSE_COST * bad, -np.inf)
        out[k] = v[int(value.argmax())] if value.max() > 0 else v[0]
    return np.maximum(out, 1e-9)


def votes_of(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """1 where a voter says toxic and 0 where it abstains; the last voter says not toxic (-1) where all others abstain."""
    votes = (x >= cut).astype(np.int8)
    return np.concatenate([votes[:, :-1], -(votes[:, :-1].sum(axis=1, keepdims=True) == 0).astype(np.int8)], axis=1)


def shares(p: np.ndarray) -> np.ndarray:
    """Posteriors with a column per class, from those or from the posterior of class 1 of two."""
    return p if p.ndim == 2 else np.stack([1 - p, p], axis=1)


def dependence(said: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The mutual information (nats) of each pair of voters given the class, with the posterior p of class 1 or of all."""
    out, n = np.zeros((said.shape[1], said.shape[1])), max(len(p), 1)
    for w in shares(p).T:
        mass = max(w.sum(), 1e-9)
        both = (said * w[:, None]).T @ said / mass
        one = np.clip(both.diagonal(), 1e-9, 1 - 1e-9)
        for i, j, joint in ((one, one, both), (one, 1 - one, one[:, None] - both), (1 - one, one, one[None, :] - both), (1 - one, 1 - one, 1 - one[:, None] - one[None, :] + both)):
            joint = np.clip(joint, 1e-12, 1.0)
            out += mass / n * joint * np.log(joint / (i[:, None] * j[None, :]))
    np.fill_diagonal(out, 0.0)
    return out


def information(said: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The entropy (nats) of each voter given the class."""
    out = np.zeros(said.shape[1])
    for w in shares(p).T:
        one = np.clip(w @ said / max(w.sum(), 1e-9), 1e-12, 1 - 1e-12)
        out -= w.sum() / max(len(p), 1) * (one * np.log(one) + (1 - one) * np.log(1 - one))
    return out


def spanning_forest(gain: np.ndarray, least: float) -> np.ndarray:
    """The parent of each node (-1 for a root) in a maximum spanning forest of edges with a gain above `least`."""
    m = len(gain)
    best, near, parent, done = np.full(m, least), np.full(m, -1), np.full(m, -1), np.zeros(m, bool)
    for _ in range(m):
        k = int(np.where(done, -np.inf, best).argmax())
        done[k], parent[k] = True, near[k]
        better = ~done & (gain[k] > best)
        best[better], near[better] = gain[k][better], k
    return parent


def vote_rates(said: np.ndarray, p: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(class masses, rates): the chance that voter k votes given the class c and whether its parent voted (a), as rates[k,
    a, c]; the same for both a where it has no parent. Rare combinations lean on the chance given the class alone."""
    w = shares(p)
    mass = w.sum(axis=0) + 1.0
    alone = (said.T @ w + 0.02) / (mass + 0.04)
    rates = np.repeat(alone[:, None, :], 2, axis=1)
    for k in np.flatnonzero(parent >= 0):
        for a in (0, 1):
            own = w * (said[:, parent[k]] == a)[:, None]
            rates[k, a] = (said[:, k] @ own + 2 * alone[k]) / (own.sum(axis=0) + 2)
    return mass, np.clip(rates, 1e-4, 1 - 1e-4)


def log_chances(said: np.ndarray, mass: np.ndarray, rates: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The log chance, up to a constant, of each class with each row of votes: the prior's, and those of each vote given the
    parent's."""
    spoke, none = said.astype(int), np.zeros(len(said), int)
    out = np.tile(np.log(mass), (len(said), 1))
    for k, q in enumerate(parent):
        chance = np.log(np.stack([1 - rates[k], rates[k]]))
        out += chance[spoke[:, k], spoke[:, q] if q >= 0 else none]
    return out


def log_odds(said: np.ndarray, mass: np.ndarray, rates: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """The log odds of any class but 0 of each row of votes."""
    chances = log_chances(said, mass, rates, parent)
    return np.logaddexp.reduce(chances[:, 1:], axis=1) - chances[:, 0]


def first_kinds(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """The kind (1, 2, ...) that each text would be of if it were toxic, to start with: again and again the voter with the most
    votes on toxic texts without a kind, if most of its votes on texts without a kind are right, makes its texts a kind. All
    others are of the largest, the first."""
    said, kind = (votes > 0).astype(float), np.zeros(len(votes), int)
    for k in range(1, KINDS + 1):
        right, every = said[(kind == 0) & toxic].sum(axis=0), said[kind == 0].sum(axis=0)
        right = np.where(2 * right > every, right, 0)
        best = int(right.argmax())
        if right[best] < max(KIND_TEXTS, KIND_SHARE * toxic.sum()):
            break
        kind[(kind == 0) & (said[:, best] > 0)] = k
    return np.maximum(kind, 1)


def label_model(votes: np.ndarray, anchor: np.ndarray, rounds: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation maximisation: (posterior of toxic, accuracy of each voter, its parent among the voters or -1).

    A vote depends on the class and on one other vote: the pairs that still depend on each other once the class is
    known, by the largest mutual information, form a forest that is estimated anew in each round, together with the
    votes' chances. Toxic texts are of several kinds, each a class with chances of its own: with one class for all of them
    the silence of the most frequent kind's voters (one language's insults, say) would be taken as evidence that texts of
    other kinds aren't toxic. The known labels (anchor) only say which classes are which, where the rounds start; they have
    no vote.
    """
    said, p = (votes != 0).astype(float), np.clip(anchor, 0.05, 0.95)
    kind = first_kinds(votes, anchor > 0.5)
    classes = np.zeros((len(p), kind.max(initial=1) + 1))
    classes[:, 0] = 1 - p
    classes[np.arange(len(p)), kind] = p
    parent = np.full(said.shape[1], -1)
    for _ in range(rounds):
        gain = dependence(said, classes)
        own = np.maximum(information(said, classes), 1e-12)
        parent = spanning_forest(np.where(gain >= LEAST_SHARED * np.minimum(own[:, None], own[None, :]), gain, 0.0), 2.0 / max(len(p), 1))
        chances = log_chances(said, *vote_rates(said, classes, parent), parent)
        classes = np.exp(chances - np.logaddexp.reduce(chances, axis=1, keepdims=True))
    p = classes[:, 1:].sum(axis=1)
    accuracy = np.where(votes.sum(axis=0) >= 0, p @ said, (1 - p) @ said) / np.maximum(said.sum(axis=0), 1)
    return p, accuracy, parent


def design(x: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The classifier's inputs: each vote, and how far each rate is from its threshold, and how many voters vote."""
    votes = (x >= cut).astype(float)
    return np.concatenate([votes, np.log1p(x), np.minimum(votes[:, :-1].sum(axis=1, keepdims=True), 5.0)], axis=1)


def fit_linear(z: np.ndarray, target: np.ndarray, decay: float = 3e-4, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent; a class weighs as the root of its mass."""
    w, b = np.zeros(z.shape[1]), 0.0
    mass = np.array([(1 - target).sum(), target.sum()]) + 1e-9
    each = target / np.sqrt(mass[1]) + (1 - target) / np.sqrt(mass[0])
    each /= each.sum()
    rate = 4.0 / (each @ np.square(z).sum(axis=1) + 1.0)
    vw, vb = w.copy(), b
    for k in range(rounds):
        off = each * (target - 1 / (1 + np.exp(-(z @ vw + vb))))
        nw, nb = vw + rate * (z.T @ off - decay * vw), vb + rate * off.sum()
        vw, vb = nw + k / (k + 3) * (nw - w), nb + k / (k + 3) * (nb - b)
        w, b = nw, nb
    return w, b


class ToxicModel:
    def __init__(self, stems: list[str], cut: np.ndarray, weights: np.ndarray, bias: float):
        self.stems, self.cut, self.weights, self.bias = stems, cut, weights, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design(x, self.cut) @ self.weights + self.bias, -30, 30)))


def _measure(stems: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer(stems)
        for b in batches:
            found = [[n, [v for pair in sorted(hits.items()) for v in pair], p] for n, hits, p in measurer.measure([t or "" for t in b.column("text").to_pylist()])]
            columns = [b.column("doc_id"), b.column("label"), pa.array([f[0] for f in found], pa.int64()), *(pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "label", "n", "hits", "patterns"])

    return run


def train(docs: DataFrame, labels: DataFrame) -> ToxicModel:
    """Voters, label model and classifier from a bounded sample (SAMPLE_DOCS) of the labelled documents that aren't
    held out. The known labels choose stems and thresholds and say which class is which; the label model estimates how
    good and how alike its voters are from the votes, and the classifier learns its posterior labels only. Without
    labels the model is the fixed insults' voters with a prior against toxicity."""
    known = known_labels(labels, "toxic").filter(crc_mod("doc_id", FOLDS) != HELD)
    known = F.broadcast(bounded_sample(known, "doc_id", SAMPLE_DOCS))
    sample = materialize(docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(known, "doc_id"))  # read once, used thrice
    stems = lexicon(sample)
    rows = sample.select("doc_id", "label", "text").mapInArrow(_measure(stems), "doc_id long, label int, n long, hits array<long>, patterns array<long>").toPandas().sort_values("doc_id", kind="stable")
    discard(sample)
    y = rows["label"].to_numpy(float)
    x = rates([(n, Counter(dict(zip(h[::2], h[1::2], strict=True))), list(p)) for n, h, p in zip(rows["n"], map(list, rows["hits"]), rows["patterns"], strict=True)], len(stems))
    if not len(y) or y.min() == y.max():
        weights = np.zeros(2 * x.shape[1] + 1)
        weights[: x.shape[1] - 1] = 6.0
        return ToxicModel(stems, np.full(x.shape[1], 1e-9), weights, -3.0)
    cut = thresholds(x, y)
    posterior, _, _ = label_model(votes_of(x, cut), y)
    return ToxicModel(stems, cut, *fit_linear(design(x, cut), posterior))


def _scorer(model: ToxicModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measurer = Measurer(model.stems)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                x = rates(measurer.measure([t or "" for t in b.column("text").to_pylist()]), len(model.stems))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.scores(x), pa.float64())], ["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    Null and empty texts are scored as texts without hits. Whole texts are read. A null doc_id is not held out;
    repeated rows get a row each; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scorer(model), "doc_id long, score double")
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_documents(docs, train(docs, table(spark, sf_dir, "labels")))
