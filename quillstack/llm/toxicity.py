"""Toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its character 3- to 5-grams (with word ends) and of itself, all hashed into one
table; a text is the mean of its distinct words, each weighted by the root of its count (a word repeated a thousand times is
no thousand signs); two linear outputs go through a softmax. A misspelling never seen shares most
of its n-grams with the word it comes from, and so its vector. For two classes the text's logit is the mean of a
number for each word, so scoring sums numbers and never builds vectors.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_map, fold, labelled_sample, read, release

WORD = re.compile(r"\w+")
BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: So many empty words, with a learned vector like any other, join each text's mean: a few words alone can't be read as
#: strongly as a long text, and a text without words is read as nothing but them.
CALM = 30


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, number of them for each word): the word's n-grams in `<word>` and the whole word, word by word."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cp = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    owner = np.repeat(np.arange(len(words)), size)
    base, step = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
    codes, owners = [], []
    gram = cp.copy()
    for n in range(2, max(GRAMS) + 1):
        gram = gram[:-1] * base + cp[n - 1 :]
        if n in GRAMS:
            at = np.flatnonzero(owner[: len(gram)] == owner[n - 1 :])
            codes.append(gram[at] + np.uint64(n))
            owners.append(owner[at])
    place = np.arange(len(cp)) - np.repeat(np.cumsum(size) - size, size)
    power = np.cumprod(np.full(int(size.max()), base, dtype=np.uint64))
    codes.append(np.add.reduceat(cp * power[place], np.cumsum(size) - size))
    owners.append(np.arange(len(words)))
    code, own = np.concatenate(codes), np.concatenate(owners)
    code = ((code ^ (code >> np.uint64(29))) * step) >> np.uint64(64 - 17)
    order = np.argsort(own, kind="stable")
    return code[order].astype(np.int64), np.bincount(own, minlength=len(words))


@dataclass
class ToxicityModel:
    """by_bucket: each bucket's vector times the difference of the two outputs' weights."""

    by_bucket: np.ndarray
    bias: float

    def word_values(self, words: list[str]) -> np.ndarray:
        ids, n = subwords(words)
        return np.add.reduceat(self.by_bucket[ids], np.cumsum(n) - n) / n if len(words) else np.zeros(0)


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, their share of the text's mean): what each n-gram adds to the mean of words that are means of n-grams."""
    counts = Counter(WORD.findall(text.lower()))
    words = [*counts, ""]
    weight = np.sqrt(np.fromiter(counts.values(), dtype=np.float64, count=len(counts)))
    weight = np.append(weight, CALM) / (weight.sum() + CALM)
    ids, n = subwords(words)
    own, at = np.unique(ids, return_inverse=True)
    return own.astype(np.int32), np.bincount(at, weights=np.repeat(weight / n, n)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, prior: float, dim: int = 8, steps: int = 800, batch: int = 128, rate: float = 0.03, decay: float = 1e-5, leave_out: float = 0.5, seed: int = 7) -> ToxicityModel:
    """Adam on the log loss over mini-batches, vectors and outputs together, for about `steps` batches.

    All words count, rare ones too: a text is held as the shares of its n-grams, of which there are at most BUCKETS. Each
    batch leaves out a part of the n-grams and the weights decay, so that all n-grams of a telling word learn and single
    texts aren't learned by heart. The bias stays at the odds of the classes; vectors start near zero, so n-grams never met
    stay neutral. With two outputs the loss moves them in opposite ways, so their difference is all that is kept, and
    a text's mean meets the outputs as a sum over its n-grams of one number each.
    """
    if len(set(labels.tolist())) < 2:  # nothing to learn: every text gets the prior
        return ToxicityModel(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    rng = np.random.default_rng(seed)
    docs = [bag(t) for t in texts]
    table = rng.normal(0, 0.01, (BUCKETS, dim)).astype(np.float32)
    out = rng.normal(0, 1, dim).astype(np.float32)  # the second output less the first
    share = float(labels.mean())
    bias = np.log(share / (1 - share))
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (table, out)]
    step = 0
    for _ in range(-(-steps // -(-len(docs) // batch))):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            ids = np.concatenate([docs[r][0] for r in rows])
            held = (rng.random(BUCKETS) >= leave_out).astype(np.float32) / (1 - leave_out)
            weight = np.concatenate([docs[r][1] for r in rows]) * held[ids]
            n = np.array([len(docs[r][0]) for r in rows])
            logit = np.add.reduceat(weight * (table @ out)[ids], np.cumsum(n) - n) + bias
            off = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - labels[rows]) / len(rows)
            slope = np.bincount(ids, weights=weight * np.repeat(off, n), minlength=BUCKETS).astype(np.float32)
            step += 1
            for q, g, (m, v) in zip((table, out), (slope[:, None] * out + decay * table, slope @ table + decay * out), state, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel((table @ out).astype(np.float32), float(np.log(prior / (1 - prior))))


def text_values(model: ToxicityModel, texts: list[str]) -> np.ndarray:
    """The logits of texts, without the workers' memo."""
    return np.array([model.by_bucket[ids] @ weight for ids, weight in map(bag, texts)]) + model.bias


def calibrate(model: ToxicityModel, texts: list[str], labels: np.ndarray, prior: float) -> ToxicityModel:
    """Moves the bias to where a score of 0.5 has the best F1 on rows the training has not seen, weighted to the prior."""
    share = labels.mean() if len(labels) else 0.0
    if not 0 < share < 1:
        return model
    value = text_values(model, texts)
    order = np.argsort(-value, kind="stable")
    hit, miss = np.cumsum(labels[order] == 1) * prior / share, np.cumsum(labels[order] == 0) * (1 - prior) / (1 - share)
    f1 = 2 * hit / (hit + miss + prior * len(labels))
    at = int(f1.argmax())
    cut = (value[order[at]] + value[order[min(at + 1, len(order) - 1)]]) / 2
    return ToxicityModel(model.by_bucket, float(model.bias - cut))


def fit_texts(texts: list[str], y: np.ndarray, prior: float, **how) -> ToxicityModel:
    unseen = np.arange(len(texts)) % 5 == 0
    pick = lambda mask: ([t for t, m in zip(texts, mask, strict=True) if m], y[mask])
    return calibrate(train(*pick(~unseen), prior, **how), *pick(unseen), prior)


def fit(documents: DataFrame, labels: DataFrame, held_out: Column, most: tuple[int, int] = (4500, 1500), **how) -> ToxicityModel:
    """Trains on at most most[y] rows with label y (a bounded sample by a hash of the id); the prior covers all learnable labels.

    A fifth of the sample is kept from the training to place the bias.
    """
    return fit_texts(*labelled_sample(documents, labels, "toxic", held_out, most), **how)


class _Values(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


_memo: dict[str, object] = {}


def scorer(docs: DataFrame, model: ToxicityModel, max_words: int = 100_000):
    """A function for workers from texts to scores. They keep the values of the words they have met (emptied at max_words)."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def scores(texts: list[str | None]) -> np.ndarray:
        m = shared.value
        if _memo.get("key") != key or len(_memo["words"]) > max_words:
            _memo.clear()
            _memo.update(key=key, words=_Values(), values=np.zeros(0, np.float32))
        words, out, calm = _memo["words"], np.zeros(len(texts)), float(m.word_values([""])[0])
        at = [np.fromiter(map(words.__getitem__, WORD.findall((t or "").lower())), dtype=np.int64) for t in texts]
        if len(words) > len(_memo["values"]):
            _memo["values"] = np.concatenate([_memo["values"], m.word_values(list(words)[len(_memo["values"]) :])])
        for i, ids in enumerate(at):
            ids, n = np.unique(ids, return_counts=True)
            n = np.sqrt(n)
            out[i] = ((_memo["values"][ids] * n).sum() + CALM * calm) / (n.sum() + CALM)
        return 1 / (1 + np.exp(-np.clip(out + m.bias, -50, 50)))

    def all_scores(column: pa.Array) -> np.ndarray:
        return np.concatenate([scores(column.slice(i, 256).to_pylist()) for i in range(0, len(column), 256)])

    return all_scores


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, text and `score`, the softmax's share for label 1 over the whole text. A text that is null or has no word is read as empty words alone."""
    scores = scorer(docs, model)

    def rows(batch) -> dict:
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "score": scores(batch.column("text"))}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, text string, score double")


def reject(docs: DataFrame, model: ToxicityModel, limit: float = 0.5) -> DataFrame:
    """docs, all columns, without the rows whose score reaches the limit."""
    scores = scorer(docs, model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(scores(batch.column("text")) < limit))
        release()

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A text that is null, empty or without words is read as empty words alone. Repeated rows score alike; equal ids with
    different texts each get their own score. Without labels of both kinds every score is the share of label 1.
    """
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(docs, read(spark, sf_dir, "labels"), held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
