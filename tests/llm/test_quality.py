import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from concordis.llm import quality as q


def plain_model(texts, symbols):
    """Interpolated modified Kneser-Ney by dictionaries: probability of a symbol after a context."""
    counts = {q.ORDER: Counter()}
    for text in texts:
        line = [0] * (q.ORDER - 1) + q._symbols(text, symbols).tolist()
        for i in range(q.ORDER - 1, len(line)):
            counts[q.ORDER][tuple(line[i - q.ORDER + 1 : i + 1])] += 1
    for order in range(q.ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    steps = {}
    for order, grams in counts.items():
        seen = [max(1, sum(n == k for n in grams.values())) for k in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        cut = [min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, left = Counter(), defaultdict(float)
        for g, n in grams.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[min(n, 3) - 1]
        steps[order] = (grams, cut, total, left)

    def probability(context, symbol):
        p = 1 / q.SYMBOLS
        for order in range(1, q.ORDER + 1):
            grams, cut, total, left = steps[order]
            c = tuple(context[q.ORDER - order :])
            if total[c]:
                n = grams.get((*c, symbol), 0)
                p = (max(n - cut[min(n, 3) - 1], 0) if n else 0) / total[c] + left[c] / total[c] * p
        return p

    return probability


def test_model_equals_plain_one(documents):
    texts = ["the cat sat on the mat.", "the dog sat on the log!", "A CAT, a Dog; 12 %%% hats", "le chat à côté"]
    symbols = q.symbol_table()
    model = q.train(documents([(i, t) for i, t in enumerate(texts)]))
    logs, plain = model.log_probabilities(), plain_model(texts, symbols)
    for text in [*texts, "unseen words zzz", "x"]:
        line = [0] * (q.ORDER - 1) + q._symbols(text, symbols).tolist()
        codes, lengths = q.gram_codes([text], symbols)
        assert lengths.tolist() == [len(text)]
        expected = [math.log(plain(line[i - q.ORDER + 1 : i], line[i])) for i in range(q.ORDER - 1, len(line))]
        assert np.allclose(logs[codes], expected, atol=1e-4)


def test_probabilities_of_a_context_add_up_to_one(documents):
    model = q.train(documents([(1, "some words and some more words")]))
    sums = np.exp(model.log_probabilities().astype(float)).reshape(-1, q.SYMBOLS).sum(axis=1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_texts_do_not_touch_each_other():
    symbols = q.symbol_table()
    apart = [q.gram_codes([t], symbols)[0].tolist() for t in ("abc", "", "de")]
    codes, lengths = q.gram_codes(["abc", "", "de"], symbols)
    assert codes.tolist() == sum(apart, []) and lengths.tolist() == [3, 0, 2]


@pytest.fixture(scope="module")
def corpus(spark, documents):
    rng = np.random.default_rng(5)
    words = "the of and to in that was his with for had you not this but from they she which are".split()
    prose = lambda: " ".join(rng.choice(words, 60)).capitalize() + "."
    junk = lambda: "".join(chr(c) for c in rng.integers(33, 126, 300))
    rows = [(i, prose(), "en" if i % 3 else None) for i in range(600)] + [(1000 + i, junk(), "en") for i in range(40)]
    labels = [(i, 1, 0) for i in range(300)] + [(1000 + i, 0, 0) for i in range(10)] + [(5, 0, 0), (None, 1, 0)]
    return documents(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_junk_goes_and_prose_stays(corpus):
    docs, labels = corpus
    rows = q.classify(docs, labels).collect()
    assert len(rows) == 640
    assert sum(r.kept for r in rows if r.doc_id < 1000) >= 590
    assert not any(r.kept for r in rows if r.doc_id >= 1000)
    stays = q.kept_documents(docs, labels).collect()
    assert sorted(r.doc_id for r in stays) == sorted(r.doc_id for r in rows if r.kept)
    assert stays[0].__fields__ == ["doc_id", "text", "lang", "source", "n_chars"]


def test_contradicting_labels_are_not_trusted(corpus):
    _, labels = corpus
    ids = [r.doc_id for r in q.trusted_ids(labels).collect()]
    assert 5 not in ids and len(ids) == 299


def test_thresholds_are_quantiles(spark):
    rows = [("en", i / 1000) for i in range(1, 1001)] + [("fr", 5.0)] * 3 + [(None, 0.5)] + [("en", None)]
    frame = spark.createDataFrame(rows, "lang string, log_perplexity double")

    def plain(lang, keep, prior):
        known = [v for _, v in rows if v is not None]
        weights = sorted([(v, 1.0) for n, v in rows if n == lang and v is not None] + [(v, prior / len(known)) for v in known])
        total = sum(w for _, w in weights)
        up_to = 0.0
        for value, weight in weights:
            up_to += weight
            if up_to >= keep * total * (1 - 1e-12):
                return value

    for keep, prior in ((0.9, 50), (0.995, 50), (0.9, 2), (0.5, 500)):
        by_language, elsewhere = q.thresholds(frame, keep=keep, margin=0.0, prior=prior)
        found = {r.lang: r.threshold for r in by_language.collect()}
        assert found == {n: pytest.approx(plain(n, keep, prior), abs=0.003) for n in ("en", "fr", None)}
        assert elsewhere == pytest.approx(plain("none of them", keep, prior), abs=0.003)
    none, elsewhere = q.thresholds(frame.where("log_perplexity > 9"))
    assert none.collect() == [] and elsewhere == float("inf")


def test_odd_rows(spark, documents, odd_texts):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (6, 1, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = q.classify(documents(odd_texts), labels).collect()
    assert len(rows) == len(odd_texts)
    assert all(r.log_perplexity is None and not r.kept for r in rows if r.doc_id in (3, 4))


def test_without_labels_or_rows(spark, documents, odd_texts):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = q.classify(documents(odd_texts), none).collect()
    assert all(r.kept == (r.doc_id not in (3, 4)) for r in rows)
    assert q.kept_documents(documents(odd_texts), none).count() == len(odd_texts) - 2
    assert q.classify(documents([]), none).collect() == []


def test_unfolded_model_equals_plain_one(spark, documents):
    """Scores by joins equal those of dictionaries over code points, whatever the script."""
    trained = ["the cat sat on the mat.", "AБВГ где кот?", "你好世界，你好", "a\x00b \U0001f600"]
    texts = [*trained, "THE CAT", "кот сидит", "世界好", "", "zq\x00"]
    points = 0x110000
    plain = plain_points(trained)
    model = q.train_points(documents(list(enumerate(trained))))
    found = {r.doc_id: r.log_perplexity for r in q._scored(documents(list(enumerate(texts))), model).collect()}
    for i, text in enumerate(texts):
        line = [32] * (q.ORDER - 1) + [ord(c) for c in text]
        logs = [math.log(plain(line[j - q.ORDER + 1 : j], line[j], points)) for j in range(q.ORDER - 1, len(line))]
        assert found[i] == (pytest.approx(-sum(logs) / len(logs)) if logs else None)


def plain_points(texts):
    counts = {q.ORDER: Counter()}
    for text in texts:
        line = [32] * (q.ORDER - 1) + [ord(c) for c in text]
        counts[q.ORDER].update(tuple(line[i - q.ORDER + 1 : i + 1]) for i in range(q.ORDER - 1, len(line)))
    for order in range(q.ORDER - 1, 0, -1):
        counts[order] = Counter(g[1:] for g in counts[order + 1])
    steps = {}
    for order, grams in counts.items():
        seen = [max(1, sum(n == k for n in grams.values())) for k in (1, 2, 3, 4)]
        y = seen[0] / (seen[0] + 2 * seen[1])
        cut = [min(max(k - (k + 1) * y * seen[k] / seen[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]
        total, left = Counter(), defaultdict(float)
        for g, n in grams.items():
            total[g[:-1]] += n
            left[g[:-1]] += cut[min(n, 3) - 1]
        steps[order] = (grams, cut, total, left)

    def probability(context, symbol, points):
        p = 1 / points
        for order in range(1, q.ORDER + 1):
            grams, cut, total, left = steps[order]
            c = tuple(context[q.ORDER - order :])
            if total[c]:
                n = grams.get((*c, symbol), 0)
                p = (n - cut[min(n, 3) - 1] if n else 0) / total[c] + left[c] / total[c] * p
        return p

    return probability


def test_scrambled_scripts_go(spark, documents):
    rng = np.random.default_rng(8)
    words = "мама мыла раму а папа читал новую книгу про дальние страны и большие города".split()
    prose = lambda: " ".join(rng.choice(words, 60))
    rows = [(i, prose(), "ru") for i in range(400)]
    rows += [(1000 + i, "".join(rng.permutation(list(rows[i][1]))), "ru") for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in q.kept_documents(documents(rows), labels).collect()}
    assert len(kept & set(range(400))) >= 390 and not kept & set(range(1000, 1040))
