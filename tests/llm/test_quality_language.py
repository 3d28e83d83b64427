"""Classifiers by their held-out accuracy, and the forward sums against enumeration."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ordina.llm import language_id, quality

SF = "/root/testdata/sf0.01"


def test_pairs_in_linear_time_equal_all_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, 4)))
    index, value = np.array([3, 8, 70, 900]), np.array([0.5, 1.0, 0.2, 0.1])
    z = m.bias + m.linear[index] @ value + sum(m.factors[index[a]] @ m.factors[index[b]] * value[a] * value[b] for a in range(4) for b in range(a))
    assert m.score(index, value) == pytest.approx(1 / (1 + math.exp(-z)))


def plain_features(text):
    """Slots of the words and bins of the statistics of one text, with Python's own means."""
    text = text or b""
    words, lines = text.lower().split(), text.split(b"\n")
    counts, n, chars = Counter(words), max(1, len(words)), max(1, len(text))
    shares = [sum(quality._KINDS[b] == k for b in text) / chars for k in range(1, 11)]
    shares += [len(counts) / n, max(counts.values(), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, 1 - len(set(lines)) / len(lines), sum(w[-1:] in b".!?" for w in words) / n, min(1, len(lines) / n)]
    bins = [sum(e < x for e in quality.EDGES) for x in shares] + [min(quality.BINS - 1, int(x * (quality.BINS - 1))) for x in (len(words).bit_length() / 20, len(text).bit_length() / 24, min(1, len(text) / n / 24))]

    def slot(word):
        h = sum((b + 1) * pow(quality._BASE, i, 1 << 64) for i, b in enumerate(word)) % (1 << 64)
        h = (h ^ (h >> 32)) * quality._BASE % (1 << 64)
        return (h ^ (h >> 29)) % quality.WORDS

    slots = sorted({slot(w) for w in counts})
    index = slots + [quality.WORDS + i * quality.BINS + b for i, b in enumerate(bins)]
    return index, [1 / math.sqrt(max(1, len(slots)))] * len(slots) + [0.5] * len(bins)


def test_features_equal_plain_ones(monkeypatch):
    rng = random.Random(3)
    make = lambda: "".join(rng.choice(["the ", "The\t", "é", "x1 ", "\n", "same same ", "end. ", "| #", "\x0b", "\u00a0", "\n\n", "a, "]) for _ in range(rng.randrange(60))).encode()
    texts = [None, b"", b" ", b"\n", b"one", *(make() for _ in range(60)), b"w " * 3000, None]
    for chunk in (quality.CHUNK, 100):
        monkeypatch.setattr(quality, "CHUNK", chunk)
        got = quality.features(texts)
        index, value = np.split(got.index, got.starts[1:]), np.split(got.value, got.starts[1:])
        assert len(index) == len(texts)
        for text, i, v in zip(texts, index, value, strict=True):
            want = plain_features(text)
            assert i.tolist() == want[0] and np.allclose(v, want[1]), text


def test_query_scores_equal_plain_scores(spark):
    """Each text alone, its pairs summed one by one in double precision."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    m = quality.train(docs, labels)
    got = {r.doc_id: (r.score, r.text) for r in quality.score_quality(docs, m).collect()}
    assert len(got) == docs.count()
    for score, text in list(got.values())[:40]:
        index, value = plain_features(text.encode() if text is not None else None)
        x, f = np.array(value), m.factors[index].astype(float)
        gram = (f @ f.T) * np.outer(x, x)
        z = m.bias + m.linear[index] @ x + (gram.sum() - np.trace(gram)) / 2
        assert score == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, z)))), abs=1e-4)


def test_sample_is_bounded_under_repeated_ids(spark):
    docs = spark.range(400).select((F.col("id") % 2).alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 7).cast("string")).alias("text"))
    labels = spark.createDataFrame([(0, 0), (1, 1), (0, 0)], "doc_id bigint, quality int")
    seen = []
    fit = quality.fit
    try:
        quality.fit = lambda rows, y, **more: seen.append((len(rows.starts), y.tolist())) or fit(rows, y, **more)
        quality.train(docs, labels, held_out=9)
    finally:
        quality.fit = fit
    assert seen == [(2, [0, 1])]


@pytest.mark.parametrize("sf, least", [("sf0.01", 0.7), ("sf0.1", 0.95)])
def test_held_out_quality(spark, sf, least):
    """sf0.01 has 11 held-out rows of label 0; the larger table has over a hundred."""
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    labelled = docs.join(labels, "doc_id", "left_semi")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    got = quality.score_quality(labelled.where(held_out), quality.train(docs, labels)).join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(r.score >= 0.3) == r.quality for r in got]) >= 0.95
    for q in (0, 1):
        own = [r for r in got if r.quality == q]
        assert sum((r.score >= 0.3) == q for r in own) / len(own) >= least


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (2, "", 1.0), (3, "x " * 100_000, 2.0), (3, "é", 3.0), (None, "a\tb", None)], "doc_id bigint, text string, score double")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 7)], "doc_id bigint, quality int")
    got = quality.score_quality(docs, quality.train(docs, labels)).collect()
    assert len(got) == 5 and all(0 <= r.score_ <= 1 for r in got) and got[1].score == 1.0
    assert quality.score_quality(docs.limit(0), quality.train(docs, labels.limit(0))).isEmpty()


def segmentations(word, model, k):
    if not word:
        return 1.0
    total = 0.0
    for n in range(1, min(len(word), language_id.LONGEST) + 1):
        piece = model.ids.get(word[:n], 0 if n == 1 else None)
        if piece is not None:
            total += model.p[piece, k] * segmentations(word[n:], model, k)
    return total


def small_model():
    counts = {"aa": Counter({"abab": 3, "ba": 2, "c": 1}), "bb": Counter({"bcb": 4, "cab": 2})}
    return language_id.fit(counts, ["▁", "a", "b", "c", "ab", "▁a", "bc", "cab", "▁ab", "never"])


def test_forward_sums_all_segmentations():
    m = small_model()
    words = ["▁abab", "▁bcbcab", "▁xyz", "▁", "▁cabcabab"]
    got = np.exp(m.log_probabilities(words))
    assert np.allclose(got, [[segmentations(w, m, k) for k in range(2)] for w in words])
    assert "never" not in m.ids and np.allclose(m.p.sum(0), 1)


def test_long_words_are_rescaled():
    m = small_model()
    w = "▁" + "abcab" * 30
    assert np.allclose(m._long(w), m.log_probabilities([w])) and np.isfinite(m._long("▁" + "ab" * 5000)).all()


def test_words_of_unseen_characters_do_not_decide():
    counts = {"aa": Counter({"abab": 300_000, "ba": 2}), "bb": Counter({"bcb": 300_000, "cab": 2})}
    m = language_id.fit(counts, ["▁", "a", "b", "c", "ab", "▁a", "bc", "cab", "▁ab"])
    for n in (1, 60, 150, 400):
        w = "▁" + "═" * n
        assert np.allclose(m.log_probabilities([w]), m._long(w)), n
        got = m.posteriors(["bcb " * 400 + "═" * n])[0]
        assert m.languages[int(got.argmax())] == "bb" and 0 <= got.min() and got.max() <= 1, n


def test_long_words_are_learned_from():
    m = language_id.fit({"aa": Counter({"ab" * 30: 5}), "bb": Counter({"bc" * 300: 5, "b": 1})}, ["▁", "a", "b", "c", "ab", "bc"])
    got = m.posteriors(["ab" * 30, "bc" * 30])
    assert {"a", "ab", "c", "bc"} <= set(m.ids) and list(got.argmax(1)) == [0, 1] and np.allclose(m.p.sum(0), 1)


def test_scores_do_not_depend_on_what_is_kept(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcx") for _ in range(rng.randrange(1, 9))) for _ in range(20)) for _ in range(30)]
    whole = small_model().posteriors(texts)
    monkeypatch.setattr(language_id, "KEPT_WORDS", 10)
    m = small_model()
    assert np.allclose(whole, np.concatenate([m.posteriors(texts[i : i + 4]) for i in range(0, 30, 4)]))


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language_id.identify(docs, language_id.train(docs, sample=60)).where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2).select("lang", "language.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) >= 0.97 and all(0 <= r.score <= 1 for r in got)


def plain_log_sum(word, model, k):
    """The logarithm of the sum over all segmentations, one position after the other."""
    word = language_id.START + word
    alpha = [0.0] + [-math.inf] * len(word)
    for j in range(1, len(word) + 1):
        terms = [alpha[i] + math.log(model.p[n, k]) for i in range(max(0, j - language_id.LONGEST), j) if (n := model.ids.get(word[i:j], 0 if j - i == 1 else None)) is not None]
        top = max(terms)
        alpha[j] = top + math.log(sum(math.exp(t - top) for t in terms))
    return alpha[-1]


def test_query_scores_equal_plain_sums(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    m = language_id.train(docs, sample=20)
    rows = language_id.identify(docs.where("length(text) < 1500"), m).select("text", "language.*").limit(25).collect()
    for r in rows:
        z = [math.log(m.prior[k]) + sum(plain_log_sum(w, m, k) for w in r.text.lower().split()) for k in range(len(m.languages))]
        p = np.exp(np.array(z) - max(z))
        p /= p.sum()
        if any(map(str.isalpha, r.text)):
            assert r.lang_pred == m.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), abs=1e-6)


def test_language_sample_reads_white_space_as_scoring_does(spark):
    docs = spark.createDataFrame([(i, t, "aa") for i, t in enumerate(["ab\u00a0cd", "ef\u3000gh", "ab"] * 3)] + [(0, "zz", "aa"), (1, "ef\u3000gh", "aa")], "doc_id bigint, text string, lang string")
    seen = []
    fit = language_id.fit
    try:
        language_id.fit = lambda counts, pieces: seen.append(counts) or fit(counts, pieces)
        language_id.train(docs, held_out=9)
    finally:
        language_id.fit = fit
    assert seen == [{"aa": Counter({"ab": 6, "cd": 3, "ef": 3, "gh": 3})}]


def test_language_edge_rows(spark):
    docs = spark.createDataFrame([(1, "ab ab c", "aa"), (3, None, "aa"), (4, "", None), (5, "12 34!", "bb"), (6, "bc " * 50_000, "bb"), (None, "ab", None), (1, "ab ab c", "aa")], "doc_id bigint, text string, lang string").withColumn("language", F.lit(1))
    got = {(r.doc_id, r.text and r.text[:3]): r.language_ for r in language_id.identify(docs, language_id.train(docs)).collect()}
    assert [got[k].lang_pred for k in ((3, None), (4, ""), (5, "12 "))] == ["und"] * 3 and got[(6, "bc ")].lang_pred == "bb"
    none = docs.limit(0)
    assert language_id.identify(none, language_id.train(none)).isEmpty()
    assert language_id.identify(docs, language_id.train(none)).select("language_.lang_pred").distinct().collect()[0][0] == "und"
