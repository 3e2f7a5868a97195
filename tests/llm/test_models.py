"""Toxicity, quality and language: held-out accuracy and odd inputs."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstack.llm import langid, quality, toxicity
from quillstack.llm.common import fold, labelled_sample

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "word " * 50_000), (6, "日本語 текст"), (None, "plain words here"), (7, "twin"), (7, "twin")]


def odd(spark):
    return spark.createDataFrame([(d, t, "x", 0) for d, t in ODD], "doc_id long, text string, score string, lang int")


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n = labels.sum()
    return (rank[labels == 1].sum() - n * (n + 1) / 2) / (n * (len(labels) - n))


def made(n=400, seed=3):
    """Texts in which a few words, written in varying ways, tell the label."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghilmnoprstu"), 6)) for _ in range(300)]
    texts, labels = [], rng.integers(0, 2, n)
    for y in labels:
        own = list(rng.choice(words, 60))
        if y:
            for _ in range(3):
                own[rng.integers(60)] = rng.choice(["vxkzzq", "vxkzzqs", "vxkzq"])
        texts.append(" ".join(own))
    return texts, labels


def test_misspellings_share_vectors():
    texts, labels = made()
    model = toxicity.train(texts[:300], labels[:300], 0.5, steps=200)
    assert auc(toxicity.text_values(model, texts[300:]), labels[300:]) > 0.8
    clean, unseen = toxicity.text_values(model, ["some plain words", "some vxkzzqz words"])
    assert unseen > clean


def test_toxicity_on_odd_texts(spark):
    texts, labels = made(120)
    model = toxicity.fit_texts(texts, labels, 0.2, steps=40)
    got = toxicity.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    kept = toxicity.reject(odd(spark), model, 2.0)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)
    assert toxicity.score(odd(spark).limit(0), model).count() == 0
    assert toxicity.fit_texts([], np.zeros(0, int), 0.3).bias == pytest.approx(np.log(0.3 / 0.7))


def test_quality_votes(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["river", "stone", "green", "walks", "slowly", "home"], 40)) for _ in range(80)]
    bad = [" ".join("$$$ ### " + w.upper() for w in rng.choice(["buy", "now", "win"], 20)) for _ in range(80)]
    texts, labels = [*good[:60], *bad[:60]], np.r_[np.ones(60, int), np.zeros(60, int)]
    model = quality.train(texts, labels, 0.8)
    assert auc(model.vote(model.project([*good[60:], *bad[60:]])), np.r_[np.ones(20, int), np.zeros(20, int)]) > 0.99
    got = quality.score(odd(spark), model).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    empty = quality.train([], np.zeros(0, int), 0.7)
    assert {r["score"] for r in quality.score(odd(spark), empty).collect()} == {0.7}


@tables
def test_languages_of_unseen_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.label(docs, langid.fit(docs, fold("doc_id", 4) != 2)).join(docs.select("doc_id", "lang"), "doc_id").where(fold("doc_id", 4) == 2)
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_spans_switch_between_languages(spark):
    train = spark.createDataFrame([(0, "en", "the thing with the other thing that they think " * 40), (1, "xx", "zuvok zuvak kuzov vokuz zukav okuz " * 40), (2, None, "nothing"), (3, "ру", "слово дело тело " * 20)], "doc_id long, lang string, text string")
    model = langid.fit(train, F.lit(True))
    mixed = spark.createDataFrame([(1, "the other thing they think zuvok kuzov vokuz zukav the thing"), (2, "дело the"), (3, None), (4, "12 --")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.label(mixed, model).collect()}
    assert [s["lang"] for s in got[1]["spans"]] == ["en", "xx", "en"] and got[1]["lang_pred"] == "en"
    assert [s["lang"] for s in got[2]["spans"]] == ["ру", "en"]
    assert [(got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) for i in (3, 4)] == [("und", 0.0, [])] * 2


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    scores, switch = rng.normal(size=(40, 3)).astype(np.float32), 1.5
    n = np.array([7, 1, 0, 5, 7, 20])
    begin = np.cumsum(n) - n
    got = langid.viterbi(scores.T, begin, n, switch)
    value = lambda s, path: sum(s[i, k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:], strict=False))
    from itertools import product

    for b, size in zip(begin, n, strict=True):
        if 0 < size <= 7:
            own = scores[b : b + size]
            assert abs(value(own, got[b : b + size].tolist()) - max(value(own, p) for p in product(range(3), repeat=int(size)))) < 1e-5


def test_languages_of_odd_texts(spark):
    train = spark.createDataFrame([(0, "en", "plain words here twin")], "doc_id long, lang string, text string")
    assert langid.label(odd(spark), langid.fit(train, F.lit(True))).count() == len(ODD)
    none = langid.fit(train.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.label(odd(spark), none).collect()} == {"und"}


def test_seventy_languages(spark):
    """More languages than any list of 64 holds, in several blocks; the spans' codes need more than eight bits of flags."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(70):
        letters = list(rng.choice(list("abcdefghijklmnoprstuvz"), 6, replace=False))
        rows.append((i, f"l{i:02d}", " ".join("".join(rng.choice(letters, 6)) for _ in range(300))))
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = langid.label(docs, langid.fit(docs, F.lit(True))).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 69


def test_one_long_text_beside_short_ones_needs_little_memory():
    """Two million words beside 400 short texts, as one call gets them."""
    import tracemalloc

    words = np.full(401, 5)
    words[7] = 2_000_000
    begin = np.cumsum(words) - words
    scores = np.random.default_rng(2).normal(size=(4, int(words.sum()))).astype(np.float32)
    tracemalloc.start()
    labels = langid.viterbi(scores[:, : 200_000 + 2000], np.minimum(begin, 200_000), np.minimum(words, 200_000), 3.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(labels) == 202_000 and peak < 100_000_000


def test_votes_go_to_the_nearest_and_of_equal_ones_to_the_earlier():
    """Exhaustive search over vectors with many exact copies."""
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 5)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    for turn in range(100):
        vectors, labels, weights = base[rng.integers(0, 12, 40)], rng.integers(0, 2, 40), rng.uniform(0.5, 2, 40)
        model = quality.QualityModel(np.ones(1), np.zeros((1, 1)), vectors, labels, weights, 1 + turn % 9, 0.3)
        asked = rng.normal(size=(6, 5)).astype(np.float32)
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        for x, got in zip(asked, model.vote(asked), strict=True):
            near = [round(float(v @ x) * (1 << 20)) for v in vectors]
            order = sorted(range(40), key=lambda i: (-near[i], i))[: model.k]
            weight = np.array([max(float(vectors[i] @ x), 0.0) ** 2 * weights[i] for i in order])
            want = (weight * labels[order]).sum() / weight.sum() if weight.sum() > 0 else 0.3
            assert got == pytest.approx(want, abs=1e-4)


def test_labelled_samples_are_bounded(spark):
    """An id that holds thousands of rows gives one; bytes are bounded too."""
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(3000)] + [(i, "x" * 100) for i in range(2, 40)] + [(50, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] + [(None, 1)], "doc_id long, toxic int")
    texts, y, prior = labelled_sample(docs, labels, "toxic", F.lit(False), (10, 10))
    assert len(texts) == len(y) <= 20 and prior == pytest.approx(30.5 / 60)
    texts, y, _ = labelled_sample(docs, labels, "toxic", F.lit(False), (100, 100))
    assert len(texts) == 40 and texts[0] == "text 0" and "" in texts
    texts, y, _ = labelled_sample(docs, labels, "toxic", F.lit(False), (100, 100), most_bytes=1000)
    assert 5 <= len(texts) <= 15 and len(y) == len(texts)
