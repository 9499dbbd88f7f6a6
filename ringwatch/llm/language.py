"""Language identification: word-first backoff from known words to progressively shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc_mod, materialize, table

FOLDS, HELD = 3, 1
#: Labelled documents of each language that the tables are counted on, about, at most; entries of each language in each table at most.
SAMPLE_DOCS, ENTRIES = 2_000, 8_000
LONGEST = 4
#: Evidence that a single word gives at most, in nats; the frequency that stands for unseen is that of so many
#: occurrences in the largest language, so what a language hasn't seen is no better there than elsewhere.
MOST, SMOOTH = 6.0, 0.5
#: Words kept with their evidence; texts predicted together.
KEPT, CHUNK = 200_000, 256
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and character n-grams of a partition's texts, counted per language before the shuffle."""
    words: dict[str, Counter] = {}
    for b in batches:
        for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
            words.setdefault(lang, Counter()).update(words_of(text or ""))
    for lang, seen in words.items():
        grams: dict[int, Counter] = {n: Counter() for n in range(1, LONGEST + 1)}
        for w, k in seen.items():
            for n, into in grams.items():
                for g in grams_of(w, n):
                    into[g] += k
        for size, found in [(0, seen), *grams.items()]:
            keys = list(found)
            for at in range(0, len(keys), 20_000):
                part = keys[at : at + 20_000]
                columns = [pa.array([size] * len(part), pa.int32()), pa.array(part), pa.array([lang] * len(part)), pa.array([found[k] for k in part], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["size", "gram", "lang", "n"])


class LanguageModel:
    """Known words (size 0) and character n-grams of each size, each with the number of its entry.

    Entry k has the languages `lang[first[k] : first[k + 1]]` that have seen it, and in `gain` how far the log frequency of
    each lies above that of unseen, which is the same in all languages."""

    def __init__(self, langs: list[str], places: dict[int, dict[str, int]], first: np.ndarray, lang: np.ndarray, gain: np.ndarray):
        self.langs, self.places, self.first, self.lang, self.gain = langs, places, first, lang, gain
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.found = np.zeros((0, len(self.langs)))

    def _rows_of(self, word: str) -> list[int]:
        """The known word's row, or at each place of an unseen word the row of its longest known n-gram."""
        own = self.places[0].get(word)
        if own is not None:
            return [own]
        marked, out = f"<{word}>", []
        sizes = [(size, self.places[size].get) for size in range(min(LONGEST, len(marked)), 0, -1)]
        for at in range(max(1, len(marked) - LONGEST + 1)):
            for size, get in sizes:
                row = get(marked[at : at + size])
                if row is not None:
                    out.append(row)
                    break
        return out

    def evidence(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word by language: its own if it is known, else the mean over its n-grams, which counts
        as much as up to three of them; none below -MOST, and 0 where not even a single character is known."""
        rows = [self._rows_of(w) for w in words]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        entry = np.fromiter((r for x in rows for r in x), np.int64, int(size.sum()))
        n = self.first[entry + 1] - self.first[entry]
        at = np.repeat(self.first[entry] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        place = np.repeat(np.repeat(np.arange(len(words)) * len(self.langs), size), n) + self.lang[at]
        out = np.bincount(place, self.gain[at], len(words) * len(self.langs)).reshape(len(words), len(self.langs))
        out *= (np.minimum(size, 3) / np.maximum(size, 1))[:, None]
        return np.maximum(out - out.max(axis=1, keepdims=True), -MOST)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """The likeliest language of each text and its posterior; ('und', 0.0) without letters or with an empty model."""
        if not self.langs:
            return [("und", 0.0)] * len(texts)
        words = [words_of(t) for t in texts]
        every = set().union(*words)
        if len(self.at) + len(every) > KEPT:
            self._clear()
        new = [w for w in every if w not in self.at]
        if new:
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            self.found = np.concatenate([self.found, self.evidence(new)])
        out = []
        for w in words:
            if not any(any(map(str.isalpha, x)) for x in w):  # numerals such as a half are in words, but no letters
                out.append(("und", 0.0))
                continue
            total = self.found[list(map(self.at.__getitem__, w))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.langs[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def language_sample(docs: DataFrame) -> DataFrame:
    """(text, lang) of about SAMPLE_DOCS documents of each language, all of a rarer one, picked by a hash of doc_id: those with a
    language that aren't held out. Written down once."""
    known = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod("doc_id", FOLDS) != HELD))
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    span = float(1 << 30)
    some = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), F.lit(1 << 30)) < F.lit(span * SAMPLE_DOCS) / F.col("n")
    return materialize(known.join(F.broadcast(sizes), "lang").filter((F.col("n") <= SAMPLE_DOCS) | some).select("text", "lang"))


def train(docs: DataFrame) -> LanguageModel:
    """A model counted on a bounded sample of each language.

    Counting is distributed. Of each table (words, n-grams of each size) the ENTRIES most frequent of each language are
    kept, with the counts of all languages: one ranked pass. Languages are those with a word or a letter in the sample."""
    counts = language_sample(docs).mapInArrow(_counts, "size int, gram string, lang string, n long").groupBy("size", "gram", "lang").agg(F.sum("n").alias("n"))
    counts = materialize(counts.withColumn("total", F.sum("n").over(W.partitionBy("size", "lang"))))
    place = F.row_number().over(W.partitionBy("size", "lang").orderBy(F.desc("n"), "gram"))
    kept = counts.withColumn("place", place).filter(F.col("place") <= ENTRIES).select("size", "gram").distinct()
    rows = counts.join(kept, ["size", "gram"], "left_semi").toPandas().sort_values(["size", "gram", "lang"], ignore_index=True)
    langs, lang = np.unique(rows["lang"].to_numpy(str), return_inverse=True)
    unseen = SMOOTH / rows.groupby("size")["total"].transform("max")
    gain = np.log1p(rows["n"] / rows["total"] / unseen).to_numpy(float)
    new = ((rows["size"] != rows["size"].shift()) | (rows["gram"] != rows["gram"].shift())).to_numpy(bool)
    first = np.flatnonzero(new)
    places: dict[int, dict[str, int]] = {n: {} for n in range(LONGEST + 1)}
    for k, (size, gram) in enumerate(zip(rows["size"].to_numpy()[first].tolist(), rows["gram"].to_numpy()[first].tolist(), strict=True)):
        places[size][gram] = k
    return LanguageModel(langs.tolist(), places, np.r_[first, len(rows)], lang.astype(np.int64), gain)


def _predict(parts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = LanguageModel(*parts.value)
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                b = batch.slice(at, CHUNK)
                found = model.predict([t or "" for t in b.column("text").to_pylist()])
                columns = [b.column("doc_id"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of docs (doc_id, text).

    A text that is null or has no letter gets 'und' with score 0; ties go to the first language in order. A null
    doc_id is not held out. Whole texts are read; repeated rows get a row each and other columns are ignored. The
    model is broadcast; its tables have ENTRIES entries a language at most.
    """
    sent = docs.sparkSession.sparkContext.broadcast((model.langs, model.places, model.first, model.lang, model.gain))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_predict(sent), "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(crc_mod("doc_id", FOLDS) == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
