"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Texts become log-scaled counts of hashed character trigrams and terms for their shape (steps of the shares of capitals,
signs, white space and repeated words), weighted by inverse document frequency over the labelled rows, and are projected on the leading singular vectors of those rows. The labelled vectors are broadcast (their number
is bounded by a parameter); every document is compared with all of them in blocks of exact cosine products, and the
`k` nearest vote with their similarity as weight.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_map, fold, labelled_sample, read

BUCKETS = 1 << 12
#: Shape terms: this many steps for each of the shares of shapes().
STEPS, SHAPES = 10, 6
TERMS = BUCKETS + STEPS * SHAPES


def shapes(text: str | None) -> list[float]:
    """Shares in 0..1: capitals among letters, signs among characters, white space, distinct words, the commonest word, words equal to the one before."""
    text = text or ""
    words = text.split()
    n, w = max(1, len(text)), max(1, len(words))
    letters = sum(map(str.isalpha, text))
    blank = n - len("".join(words)) if words else n
    counts = Counter(words)
    upper = sum(map(str.isupper, words)) / w
    same = sum(map(str.__eq__, words, words[1:])) / w
    return [upper, min(1.0, max(0, n - letters - blank) / n * 3), blank / n, len(counts) / w, max(counts.values(), default=0) / w, same]


def terms(texts: list[str | None], weight: float = 6.0) -> np.ndarray:
    """(texts x TERMS) log-scaled trigram counts, then one step of each shape set to the weight."""
    out = np.zeros((len(texts), TERMS), dtype=np.float32)
    out[:, :BUCKETS] = np.log1p(trigram_counts(texts))
    share = np.array([shapes(t) for t in texts])
    step = np.minimum((np.sqrt(share) * STEPS).astype(int), STEPS - 1)
    out[np.arange(len(texts))[:, None], BUCKETS + np.arange(SHAPES) * STEPS + step] = weight
    return out


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """(texts x buckets) counts of byte trigrams; two marks of text end stand before and after."""
    raw = [b"\x02\x02" + (t or "").encode() + b"\x03\x03" for t in texts]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    a = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint32)
    doc = np.repeat(np.arange(len(raw)), size)
    code = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1] * np.uint32(0x85EBCA77) + a[2:] * np.uint32(0xC2B2AE3D))
    code = ((code ^ (code >> np.uint32(15))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - 12)
    own = doc[2:] == doc[:-2]
    return np.bincount(doc[2:][own] * BUCKETS + code[own], minlength=len(raw) * BUCKETS).reshape(len(raw), BUCKETS)


@dataclass
class QualityModel:
    idf: np.ndarray
    axes: np.ndarray  # buckets x dims
    vectors: np.ndarray  # labelled rows x dims, of length one
    labels: np.ndarray
    weights: np.ndarray  # of each labelled row, so that classes count by their share of all labels
    k: int
    prior: float

    def project(self, texts: list[str | None]) -> np.ndarray:
        x = terms(texts) * self.idf
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        v = x @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def vote(self, vectors: np.ndarray, block: int = 1024) -> np.ndarray:
        """The weighted share of label 1 among the k most similar labelled rows; equal similarities go to the earlier row.

        Similarities are compared as multiples of 2^-20, so that rounding in the product doesn't tell copies apart.
        """
        out = np.full(len(vectors), self.prior)
        n, k = len(self.vectors), min(self.k, len(self.vectors))
        for at in range(0, len(vectors) if k else 0, block):
            near = np.rint(vectors[at : at + block] @ self.vectors.T * (1 << 20)).astype(np.int64)
            # the row's number below the similarity makes all keys different and the earlier row the larger one
            keys = near * n + np.arange(n - 1, -1, -1)
            top = np.sort(np.argpartition(-keys, k - 1, axis=1)[:, :k], axis=1)
            near = near / (1 << 20)
            weight = np.maximum(np.take_along_axis(near, top, axis=1), 0.0) ** 2 * self.weights[top]
            total = weight.sum(axis=1)
            out[at : at + block] = np.where(total > 0, (weight * self.labels[top]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.clip(out, 0.0, 1.0)


def train(texts: list[str], labels: np.ndarray, prior: float, dims: int = 48, k: int = 25, seed: int = 11) -> QualityModel:
    """Latent-semantic axes by randomised subspace iteration on the labelled rows."""
    if not texts:
        return QualityModel(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), k, prior)
    x = np.concatenate([terms(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    idf = np.log((1 + len(texts)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + 1
    x *= idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    rng = np.random.default_rng(seed)
    wide = min(dims + 16, *x.shape)
    q = np.linalg.qr(x.T @ (x @ rng.normal(size=(x.shape[1], wide)).astype(np.float32)))[0]
    for _ in range(4):
        q = np.linalg.qr(x.T @ (x @ q))[0]
    axes = (q @ np.linalg.svd(x @ q, full_matrices=False)[2].T)[:, :dims].astype(np.float32)
    share = np.clip(labels.mean(), 1e-6, 1 - 1e-6)
    model = QualityModel(idf, axes, np.zeros((0, axes.shape[1]), np.float32), labels, np.where(labels == 1, prior / share, (1 - prior) / (1 - share)), k, prior)
    v = x @ axes
    model.vectors = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return model


def fit(documents: DataFrame, labels: DataFrame, held_out: Column, most: tuple[int, int] = (1500, 1500), **how) -> QualityModel:
    """Fits on at most most[y] rows with label y (a bounded sample by a hash of the id); the prior covers all learnable labels."""
    texts, y, prior = labelled_sample(documents, labels, "quality", held_out, most)
    return train(texts, y, prior, **how)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """docs with `score`, the neighbours' vote for label 1 over the whole text. Null counts as empty; an empty text is compared like any other."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batch) -> dict:
        m, texts, vectors = shared.value, batch.column("text").to_pylist(), []
        at = 0
        while at < len(texts):  # about a million characters together, 256 texts at most
            end, size = at, 0
            while end < len(texts) and end - at < 256 and (end == at or size < 1_000_000):
                size += len(texts[end] or "")
                end += 1
            vectors.append(m.project(texts[at:end]))
            at = end
        return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "score": m.vote(np.concatenate(vectors))}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, text string, score double")


def op5_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted.

    A null text counts as empty; an empty one is compared like any other. A null id is not held out unless the crc of the
    empty text says so, and has no label. Repeated rows score alike. Without any labels all scores are the prior, one half.
    """
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 5) == 0
    model = fit(docs, read(spark, sf_dir, "labels"), held_out)
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
