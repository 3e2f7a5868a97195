"""Language identification of mixed text: scripts narrow the candidates, Viterbi over word scores labels spans.

A word is a run of letters. Its score for a language is the smoothed log likelihood of its character trigrams
(with word ends), learned from labelled documents. The script ranges of its characters leave only the languages that
the training text writes in that script. Viterbi then picks the best language for each word where every switch
costs `switch`. Spans are runs of equal labels; a document's language is the one whose spans hold most letters.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_map, cut, drop, fold, read

BUCKETS = 1 << 16
#: First code points of script ranges (fixed values of the Unicode standard) and the script that starts there; 0 is none of its own.
SCRIPTS = [(0, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xAA, 1), (0xAB, 0), (0xB5, 1), (0xB6, 0), (0xBA, 1), (0xBB, 0), (0xC0, 1), (0x2B0, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 10), (0x10A0, 11), (0x1100, 12), (0x1200, 13), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3041, 14), (0x3100, 15), (0x3130, 12), (0x31F0, 14), (0x3400, 15), (0xA000, 0), (0xAC00, 12), (0xD7B0, 0), (0xF900, 15), (0xFB00, 1), (0xFB1D, 5), (0xFB50, 6), (0xFE00, 0), (0xFF21, 1), (0xFF66, 14), (0xFFA0, 0), (0x20000, 15), (0x30000, 0)]
_STARTS, _KINDS = np.array([a for a, _ in SCRIPTS], dtype=np.uint32), np.array([k for _, k in SCRIPTS], dtype=np.int64)
_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Whether each code point is a letter; made once in a process."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000))
    return _letters[0]


def words_of(texts: list[str | None]) -> dict[str, np.ndarray]:
    """Words of all texts: doc, size (letters), script, and the trigram codes with the first index of each word's."""
    lower = [(t or "").lower() for t in texts]
    joined = "\n".join(lower) + "\n"
    cp = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    is_letter = letter_table()[cp]
    lengths = np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)) + 1
    edge = np.diff(is_letter.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(np.cumsum(lengths), begin, side="right")
    # a word of n letters has n trigrams: those centred on its letters, where what is no letter counts as one mark
    shown = np.where(is_letter, cp, np.uint32(1)).astype(np.uint32)
    code = np.empty(len(cp), dtype=np.uint32)
    if len(cp) > 1:
        left, right = np.empty_like(shown), np.empty_like(shown)
        left[0], left[1:], right[-1], right[:-1] = 1, shown[:-1], 1, shown[1:]
        code = left * np.uint32(0x9E3779B1) + shown * np.uint32(0x85EBCA77) + right * np.uint32(0xC2B2AE3D)
        code ^= code >> np.uint32(15)
        code = (code * np.uint32(0x27D4EB2F)) >> np.uint32(16)
    code = code[is_letter]
    size = end - begin
    first = np.cumsum(size) - size
    own = cp[is_letter]
    script = np.ones(len(own), dtype=np.int64)
    far = np.flatnonzero(own >= 0x2B0)
    if len(far):
        script[far] = _KINDS[np.searchsorted(_STARTS, own[far], side="right") - 1]
    return {"doc": doc, "size": size, "code": code, "first": first, "script": np.maximum.reduceat(script, first) if len(first) else script[:0]}


class LanguageModel:
    """Trigram log likelihoods (languages x buckets) and, by script, the languages written in it."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray, smooth: float = 0.5, rare: float = 0.01):
        self.langs = langs
        totals = counts.sum(axis=1, keepdims=True, dtype=np.float64)
        self.logp = np.log((counts + smooth) / (totals + smooth * BUCKETS)).astype(np.float32)
        # a script belongs to the languages that have over `rare` of their letters in it; an unseen one to all
        shares = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = (shares > rare).T
        self.allowed[~self.allowed.any(axis=1)] = True

    def word_scores(self, w: dict[str, np.ndarray], off: float = -1e6) -> np.ndarray:
        """(languages x words)"""
        out = np.empty((len(self.langs), len(w["size"])), dtype=np.float32)
        for k in range(len(self.langs)) if len(w["size"]) else ():
            np.add.reduceat(self.logp[k][w["code"]], w["first"], out=out[k])
            out[k][~self.allowed[:, k][w["script"]]] += np.float32(off)
        return out


def viterbi(scores: np.ndarray, begin: np.ndarray, n: np.ndarray, switch: float, block: int = 1024) -> np.ndarray:
    """The best label of each word from scores (languages x words). Documents (first word, number of words) of like length go
    word by word together. What is held for the way back is a number a word and language, whatever the lengths."""
    labels = np.zeros(scores.shape[1], dtype=np.int16)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    kind = np.uint8 if len(scores) <= 256 else np.uint16
    for at in range(0, len(order), block):
        docs = order[at : at + block]
        first, size = begin[docs], n[docs]
        longest = int(size[0])
        best = scores[:, first].astype(np.float64)
        live_at = np.searchsorted(-size, -np.arange(longest), side="left").tolist()  # documents with a word at each step
        tops, stays = [], []
        for step in range(1, longest):
            live = live_at[step]
            now = best[:, :live]
            tops.append(now.argmax(axis=0).astype(kind))
            jump = now.max(axis=0) - switch
            stays.append(np.packbits(now >= jump, axis=0))
            np.maximum(now, jump, out=now)
            now += scores[:, first[:live] + step]
        state = best.argmax(axis=0)
        labels[first + size - 1] = state
        for step in range(longest - 1, 0, -1):
            live = live_at[step]
            own = state[:live]
            stay = (stays[step - 1][own >> 3, np.arange(live)] >> (7 - (own & 7))) & 1
            state[:live] = np.where(stay == 1, own, tops[step - 1])
            labels[first[:live] + step - 1] = state[:live]
    return labels


def fit(docs: DataFrame, known: Column, at_once: int = 32) -> LanguageModel:
    """Trigram counts over all rows for which `known` holds and lang is not null.

    Only languages x buckets counts reach the driver, those of `at_once` languages at a time; the model takes a quarter of a
    megabyte a language.
    """
    rows_in = docs.where(known & F.col("lang").isNotNull()).select("lang", "text")
    langs = sorted(r["lang"] for r in rows_in.select("lang").distinct().collect())

    number = {x: k for k, x in enumerate(langs)}

    def rows(batch) -> dict | None:
        own: dict[str, list] = {}
        out: dict[str, list] = {"lang": [], "kind": [], "at": [], "n": []}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own.setdefault(lang, []).append(text)
        for lang, texts in own.items():
            k, w = number[lang], words_of(texts)
            for kind, n in ((0, np.bincount(w["code"], minlength=1)), (1, np.bincount(w["script"], weights=w["size"], minlength=1).astype(np.int64))):
                at = np.flatnonzero(n)
                for name, part in (("lang", np.full(len(at), k)), ("kind", np.full(len(at), kind)), ("at", at), ("n", n[at])):
                    out[name].append(part)
        return {c: np.concatenate(v) for c, v in out.items()}

    counts, scripts = np.zeros((max(1, len(langs)), BUCKETS), np.float32), np.zeros((max(1, len(langs)), int(_KINDS.max()) + 1))
    if langs:
        summed = cut(arrow_map(rows_in, rows, "lang int, kind int, at int, n long").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")), "counts")
        for lo in range(0, len(langs), at_once):
            got = summed.where(F.col("lang").between(lo, lo + at_once - 1)).toArrow()
            lang, kind, at, n = (got.column(c).to_numpy() for c in ("lang", "kind", "at", "n"))
            counts[lang[kind == 0], at[kind == 0]] = n[kind == 0]
            scripts[lang[kind == 1], at[kind == 1]] = n[kind == 1]
        drop(summed)
    return LanguageModel(langs or ["und"], counts, scripts)


def label(docs: DataFrame, model: LanguageModel, switch: float = 12.0) -> DataFrame:
    """doc_id, lang_pred, score (share of letters in that language's spans) and the spans (lang, first word, words) of every text.

    A text that is null or has no letter is `und` with score 0 and no spans. Equal shares go to the language that
    sorts first. Very long texts are labelled whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def some(texts: list[str | None], out: dict) -> None:
        m = shared.value
        w = words_of(texts)
        n = np.bincount(w["doc"], minlength=len(texts))
        begin = np.cumsum(n) - n
        labels = viterbi(m.word_scores(w), begin, n, switch)
        letters = np.bincount(w["doc"] * len(m.langs) + labels, weights=w["size"], minlength=len(texts) * len(m.langs)).reshape(len(texts), -1)
        cut = np.r_[True, (labels[1:] != labels[:-1]) | (w["doc"][1:] != w["doc"][:-1])] if len(labels) else np.zeros(0, bool)
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.r_[starts, len(labels)])
        spans: list[list] = [[] for _ in texts]
        for s, size, d, k in zip(starts.tolist(), sizes.tolist(), w["doc"][starts].tolist(), labels[starts].tolist(), strict=True):
            spans[d].append({"lang": m.langs[k], "first": s - int(begin[d]), "words": size})
        top = letters.argmax(axis=1)
        total = letters.sum(axis=1)
        out["lang_pred"] += [m.langs[k] if t else "und" for k, t in zip(top, total, strict=True)]
        out["score"] += np.where(total > 0, letters[np.arange(len(texts)), top] / np.maximum(total, 1), 0.0).tolist()
        out["spans"] += spans

    def rows(batch) -> dict:
        out: dict = {"lang_pred": [], "score": [], "spans": []}
        texts, at = batch.column("text").to_pylist(), 0
        most = max(100_000, 1_000_000 // max(1, len(shared.value.langs) // 8))
        while at < len(texts):  # so many characters together, fewer if there are many languages; a longer text alone
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
                size += len(texts[end] or "")
                end += 1
            some(texts[at:end], out)
            at = end
        return out | {"doc_id": batch.column("doc_id")}

    return arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,words:int>>")


def op9_lang_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score, n_spans (see label for null, empty and very long texts and ties).

    Repeated rows are alike. Without any learnable row every text is `und`.
    """
    docs = read(spark, sf_dir, "documents")
    out = label(docs, fit(docs, fold("doc_id", 4) != 2))
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))
