"""Quality, toxicity, language and line labelling: held-out accuracy, odd inputs, and the parts that have exact answers."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ringwatch.llm import language, lines, quality, textstats, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def known(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def held(doc_id, n, k):
    return zlib.crc32(str(doc_id).encode()) % n == k


def test_quality_held_out(spark, known):
    rows = quality.op8_quality_classifier(spark, SF).collect()
    assert len(rows) == len(known[0]) and all(r.held_out == held(r.doc_id, 4, 2) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in rows)
    mine = [r for r in rows if r.held_out and r.doc_id in known[1]]
    assert np.mean([r.predicted == known[1][r.doc_id].quality for r in mine]) > 0.9


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit_model(x[:3000], y[:3000], rounds=40)
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.93
    assert quality.fit_model(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]


def test_scores_are_sums_of_lookups(documents):
    texts = [r.text or "" for r in documents.values()]
    x = np.array([quality.features(t) for t in texts])
    model = quality.fit_model(x, np.array([len(t) % 3 == 0 for t in texts], float), rounds=10)
    assert len(model.pairs) == quality.PAIRS
    for row, score in zip(x.tolist(), model.score(x), strict=True):
        total = model.bias + sum(values[sum(v >= e for e in edges)] for v, edges, values in zip(row, model.edges, model.single, strict=True))
        for (a, b), values in model.pairs.items():
            total += values[sum(row[a] >= e for e in model.coarse[a]), sum(row[b] >= e for e in model.coarse[b])]
        assert score == pytest.approx(1 / (1 + np.exp(-total)))


def test_quality_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0, 0), (3, 1, 0), (8, 1, 1), (8, 0, 0), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    for docs, marks in ((odd, labels), (odd, labels.limit(0)), (empty, labels)):
        model = quality.fit_on(docs, marks)
        assert quality.score_documents(docs, model).count() == docs.count()
        assert quality.keep_good(docs, model).columns == docs.columns
        toxic = toxicity.train(docs, marks)
        assert all(0 <= r.score <= 1 for r in toxicity.score_documents(docs, toxic).collect())
        found = language.identify(docs, language.train(docs)).collect()
        assert len(found) == docs.count() and all(r.lang_pred == "und" for r in found if r.doc_id in (0, 1, 2, 4))
        judged = lines.judge_documents(docs, lines.fit_on(docs, marks)).collect()
        assert len(judged) == docs.count() and all(r.base_failed and not r.kept for r in judged if r.doc_id in (0, 1, 2, 3))


def test_toxicity_held_out(spark, known):
    rows = toxicity.op6_toxicity(spark, SF).collect()
    assert len(rows) == len(known[0]) and all(r.held_out == held(r.doc_id, 5, 0) and r.predicted == int(r.score >= 0.5) for r in rows)
    mine = [(r.predicted, known[1][r.doc_id].toxic) for r in rows if r.held_out and r.doc_id in known[1]]
    assert np.mean([a == b for a, b in mine]) > 0.9


def test_label_model_counts_copies_of_a_voter_once():
    r = np.random.default_rng(4)
    y = r.random(3000) < 0.3
    good = [np.where(r.random(3000) < 0.85, y, ~y) for _ in range(3)]
    poor = np.where(r.random(3000) < 0.6, y, ~y)
    votes = np.stack([*good, *[poor] * 5, np.zeros(3000, bool)], axis=1).astype(np.int8)
    p, accuracy, parent = toxicity.label_model(votes, np.where(r.random(3000) < 0.8, y, ~y).astype(float))
    assert ((p > 0.5) == y).mean() > 0.9 and accuracy[:3].min() > accuracy[3]
    copies = [k for k in range(3, 8) if parent[k] in range(3, 8)]
    assert len(copies) == 4 and not any(parent[k] >= 0 for k in range(3))


def test_label_model_keeps_kinds_whose_voters_exclude_each_other():
    """One language with most of the toxic texts and voters, three with few: none of them counts as not toxic."""
    r = np.random.default_rng(6)
    kind = r.choice(5, size=4000, p=[0.88, 0.066, 0.018, 0.018, 0.018])
    mine = np.repeat([1, 2, 3, 4], [10, 8, 8, 8])
    votes = r.random((4000, len(mine))) < np.where(kind[:, None] == mine, np.where(mine == 1, 0.5, 0.35), 0.0001)
    votes = np.concatenate([votes, -(~votes.any(axis=1, keepdims=True)).astype(int)], axis=1).astype(np.int8)
    p, _, _ = toxicity.label_model(votes, (kind > 0).astype(float))
    assert all((p > 0.5)[kind == k].mean() > 0.9 for k in (1, 2, 3, 4)) and (p > 0.5)[kind == 0].mean() < 0.01
    p, accuracy, parent = toxicity.label_model(votes[:0], np.zeros(0))
    assert len(p) == 0 and len(accuracy) == len(parent) == len(mine) + 1


def test_parts_of_the_label_model_against_brute_force():
    """Small vote tables: mutual information, spanning forest, vote chances and posterior, each by plain enumeration."""
    r = random.Random(2)
    for _ in range(30):
        n, m = r.randrange(5, 40), r.randrange(2, 5)
        said = np.array([[r.random() < 0.4 for _ in range(m)] for _ in range(n)], float)
        p = np.array([r.random() for _ in range(n)])
        gain = toxicity.dependence(said, p)
        for i, j in itertools.combinations(range(m), 2):
            total = 0.0
            for w in (1 - p, p):
                for a, b in itertools.product((0, 1), repeat=2):
                    joint = w[(said[:, i] == a) & (said[:, j] == b)].sum() / w.sum()
                    alone = w[said[:, i] == a].sum() * w[said[:, j] == b].sum() / w.sum() ** 2
                    total += w.sum() / n * joint * np.log(joint / alone) if joint > 0 else 0.0
            assert gain[i, j] == pytest.approx(total, abs=1e-6) == gain[j, i]
        parent = toxicity.spanning_forest(gain, 0.01)
        edges = [e for e in itertools.combinations(range(m), 2) if gain[e] > 0.01]

        def acyclic(chosen):
            group = list(range(m))
            for a, b in chosen:
                if group[a] == group[b]:
                    return False
                group = [group[a] if g == group[b] else g for g in group]
            return True

        best = max(sum(gain[e] for e in c) for k in range(m) for c in itertools.combinations(edges, k) if acyclic(c))
        assert sum(gain[k, q] for k, q in enumerate(parent) if q >= 0) == pytest.approx(best)
        mass, rates = toxicity.vote_rates(said, p, parent)
        odds = toxicity.log_odds(said, mass, rates, parent)
        for row in range(n):
            like = [mass[c] for c in (0, 1)]
            for c, w in enumerate((1 - p, p)):
                for k, q in enumerate(parent):
                    alone = (w[said[:, k] == 1].sum() + 0.02) / (w.sum() + 1.04)
                    own = said[:, q] == said[row, q]
                    chance = alone if q < 0 else (w[own & (said[:, k] == 1)].sum() + 2 * alone) / (w[own].sum() + 2)
                    like[c] *= chance if said[row, k] else 1 - chance
            assert odds[row] == pytest.approx(np.log(like[1] / like[0]), abs=1e-6)


def test_patterns():
    assert sum(toxicity.pattern_hits("you 1d1ot, you m0ron")) >= 2 and sum(toxicity.pattern_hits("i.d.i.o.t")) == 1 and sum(toxicity.pattern_hits("a clean sentence")) == 0


def test_language_held_out(spark, known):
    rows = language.op2_language_id(spark, SF).collect()
    assert len(rows) == len(known[0]) and all(r.held_out == held(r.doc_id, 3, 1) for r in rows)
    mine = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == known[0][r.doc_id].lang for r in mine]) > 0.97


def test_backoff():
    gain = np.log([9.0, 2.0, 3.0, 4.0])
    model = language.LanguageModel(["a", "b"], {0: {"known": 0}, 1: {}, 2: {"un": 1}, 3: {}, 4: {"<unk": 2}}, np.array([0, 1, 3, 4]), np.array([0, 0, 1, 1]), gain)
    assert model._rows_of("known") == [0] and model._rows_of("unk") == [2, 1] and model._rows_of("zz") == [] and model._rows_of("sun") == []
    assert model.predict(["known known", "", "123", "½ ² _"]) == [("a", pytest.approx(81 / 82)), *[("und", 0.0)] * 3]
    # an unseen word is the mean of its n-grams and counts as much as up to three of them: <unk says 4 for b, un 2 for a and 3 for b
    assert np.allclose(model.evidence(["unk", "zz"]), [[np.log(2 / 12), 0], [0, 0]])


def brute_language(text, docs, langs):
    """Word-first backoff in plain Python: counts of words and n-grams of the training texts, all of them known."""
    tables = {n: {} for n in range(language.LONGEST + 1)}
    for lang, doc in docs:
        for w in re.findall(r"[^\W\d_]+", doc.lower()):
            for n in tables:
                for g in [w] if n == 0 else [f"<{w}>"[k : k + n] for k in range(len(w) + 3 - n)]:
                    tables[n].setdefault(g, Counter())[lang] += 1
    sums = {n: [sum(c[lang] for c in table.values()) for lang in langs] for n, table in tables.items()}

    def logs(n, g):
        found = [np.log(tables[n][g][lang] / total + language.SMOOTH / max(sums[n])) for lang, total in zip(langs, sums[n], strict=True)]
        return np.array(found) - max(found)

    total = np.zeros(len(langs))
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        if w in tables[0]:
            own = logs(0, w)
        else:
            marked, parts = f"<{w}>", []
            for at in range(max(1, len(marked) - language.LONGEST + 1)):
                parts += next(([logs(n, marked[at : at + n])] for n in range(min(language.LONGEST, len(marked)), 0, -1) if marked[at : at + n] in tables[n]), [])
            own = sum(parts) * (min(len(parts), 3) / len(parts)) if parts else np.zeros(len(langs))
        total += np.maximum(own - own.max(), -language.MOST)
    return langs[int(total.argmax())], 1 / np.exp(total - total.max()).sum()


def test_language_against_brute_force(spark, sf, documents):
    docs = [(r.lang, r.text) for r in documents.values() if r.lang is not None and r.text is not None and not held(r.doc_id, 3, 1)]
    model = language.train(spark.read.parquet(f"{sf}/documents.parquet"))
    for r in [r for r in documents.values() if r.text and re.search(r"[a-z]", r.text) and len(r.text) < 3000][:5]:
        lang, score = brute_language(r.text, docs, model.langs)
        got = model.predict([r.text])[0]
        assert got[0] == lang and got[1] == pytest.approx(score, abs=1e-6)


def test_rare_and_many_languages(spark, monkeypatch):
    """All documents of a rare language are learned; it doesn't win what no language has seen; fifty languages keep apart."""
    monkeypatch.setattr(language, "SAMPLE_DOCS", 20)
    monkeypatch.setattr(language, "ENTRIES", 60)
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    kinds = {f"l{k:02}": ["".join(r.choices(r.sample(letters, 7), k=r.randint(4, 8))) for _ in range(30)] for k in range(50)}
    rows = [(lang, " ".join(r.choices(words, k=12))) for lang, words in kinds.items() for _ in range(3 if lang == "l07" else 30)]
    rows += [("none", "... 12 !!")] * 3
    r.shuffle(rows)
    model = language.train(spark.createDataFrame([(k, t, lang) for k, (lang, t) in enumerate(rows) if not (lang == "l07" and held(k, 3, 1))] + [(10_000 + k, " ".join(kinds["l07"][k : k + 9]), "l07") for k in range(3, 30, 9)], "doc_id long, text string, lang string"))
    assert model.langs == sorted(kinds)
    texts = [(lang, " ".join(r.choices(words, k=10))) for lang, words in kinds.items() for _ in range(4)]
    got = model.predict([t for _, t in texts])
    assert sum(g[0] == lang for g, (lang, _) in zip(got, texts, strict=True)) >= 0.97 * len(texts)
    unseen = model.evidence(["ñññ", "ååå"])
    assert (np.abs(unseen) < 1).all()


def test_a_small_language_has_no_advantage(spark):
    english = [(k, "the brown fox jumps over a lazy dog and runs home again", "en") for k in range(200)]
    german = [(1000 + k, "der braune hund springt über den faulen fuchs und läuft heim", "de") for k in range(200)]
    small = [(3000 + k, "qqa qqe qqi", "xx") for k in range(4)]
    model = language.train(spark.createDataFrame(english + german + small, "doc_id long, text string, lang string"))
    assert model.langs == ["de", "en", "xx"]
    assert [g[0] for g in model.predict(["brown foxes jumping", "braune hunde springen", "qqa qqi"])] == ["en", "de", "xx"]


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {p for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for p in range(k, k + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_base_counts(documents):
    random.seed(3)
    texts = ["".join(random.choice(["a", "b", " ", "\n", "\x0b", "\xa0", " a b ", "\n\n", "\x1c", "é", "|"]) for _ in range(random.randrange(90))) for _ in range(3000)]
    for text in [*texts, *[r.text or "" for r in documents.values()]]:
        assert textstats.base_counts(text) == brute_counts(text)


def test_viterbi_is_the_best_path():
    random.seed(1)
    field = lines.LineField(np.zeros(3), 0.0, np.array([[0.3, -0.2], [-0.5, 0.4]]))
    for _ in range(200):
        scores = [random.gauss(0, 1) for _ in range(random.randrange(1, 8))]
        value = lambda labels, s=scores: sum(a * b for a, b in zip(labels, s, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(labels))
        assert abs(value(field.viterbi(scores)) - max(map(value, itertools.product((0, 1), repeat=len(scores))))) < 1e-9
    assert field.viterbi([]) == []


def test_rules_keep_clean_documents(spark, known):
    rows = {r.doc_id: r for r in lines.op10_quality_rules(spark, SF).collect()}
    assert len(rows) == len(known[0])
    for k, r in rows.items():
        counts = brute_counts(known[0][k].text or "")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0]) and not (r.kept and r.base_failed)
    judged = [(rows[k].kept, l.quality) for k, l in known[1].items() if not rows[k].base_failed]
    assert np.mean([a == b for a, b in judged]) > 0.9 and np.mean([a for a, b in judged if b]) > 0.97


def test_verdict_on_documents_that_were_not_fitted(spark, known):
    docs, marks = known
    half = spark.read.parquet(f"{SF}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 2 = 0")
    field = lines.fit_on(spark.read.parquet(f"{SF}/documents.parquet"), half)
    judged = []
    for k, label in marks.items():
        text = docs[k].text or ""
        counts = brute_counts(text)
        if zlib.crc32(str(k).encode()) % 2 and counts[0] >= 20 and 100 * counts[4] <= 30 * counts[0]:
            measures = np.array(textstats.line_measures(text)).reshape(-1, len(textstats.LINE_MEASURES))
            if len(measures) <= 10:  # decoding by trying every labelling
                scores = field.scores(measures)
                best = max(itertools.product((0, 1), repeat=len(measures)), key=lambda x: sum(a * b for a, b in zip(x, scores, strict=True)) + sum(field.step[a, b] for a, b in itertools.pairwise(x)))
                assert lines.content_share(field, text) == pytest.approx((measures[:, 0] * best).sum() / measures[:, 0].sum())
            judged.append((lines.content_share(field, text) >= lines.LEAST_CONTENT, label.quality))
    assert len(judged) > 50 and np.mean([a == b for a, b in judged]) > 0.9


def test_sampled_lines_come_from_the_whole_text():
    from ringwatch.llm import lines
    from ringwatch.llm.textstats import line_measures

    long = ["\n".join(f"line {d} {k} " + "word " * (k % 9) for k in range(200)) for d in range(40)]
    picked = [lines.sample_lines(t) for t in long]
    assert all(56 <= len(p) <= lines.SAMPLE_LINES for p in picked) and picked == [lines.sample_lines(t) for t in long]
    assert any(list(p[-1]) == list(line_measures(t)[-1]) for p, t in zip(picked, long, strict=True))
    assert all(p != line_measures(t)[: lines.SAMPLE_LINES] for p, t in zip(picked, long, strict=True))
    assert lines.sample_lines("a b\nc d") == line_measures("a b\nc d")
