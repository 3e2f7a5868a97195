"""Benchmark decontamination by greedy string tiling.

Karp-Rabin hashes of `least` tokens join documents with benchmark items. For each pair that shares such a seed, seeds on
one diagonal grow into maximal common runs; the longest run is marked again and again, runs that meet marked tokens are
cut down to what is free, until none has `least` tokens. The marked share of the item's tokens (its coverage) doesn't
depend on the order of the passages, so reordered copies are caught. An item of fewer than `least` tokens is one seed: it
matches where all of it stands in a row.

The benchmark is worked off in blocks of bounded size, one at a time: a block is read, broadcast, used and destroyed.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_map, cut, read, release, unique_name

WORD = re.compile(r"\w+")
LEAST, COVERAGE = 5, 0.5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    return WORD.findall((text or "").lower())


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of n ids."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    x = ids.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(x) - n + 1, np.uint64)
    for k in range(n):
        out = out * _BASE + x[k : len(x) - n + 1 + k]
    return out


def diagonals(p: np.ndarray, t: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (first in item, first in text, length) of the seeds at (p, t)."""
    if not len(p):
        return p, t, p
    order = np.lexsort((t, t - p))
    p, t = p[order], t[order]
    new = np.r_[True, ((t - p)[1:] != (t - p)[:-1]) | (t[1:] != t[:-1] + 1)]
    at = np.flatnonzero(new)
    return p[at], t[at], np.diff(np.r_[at, len(p)]) + least - 1


def swept(item: np.ndarray, text: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same runs without a list of seeds: row by row of the item, so that memory is that of the text and the runs."""
    before, out = np.zeros(len(text) + 1, np.int64), []
    for p in range(len(item) + 1):
        now = np.zeros(len(text) + 1, np.int64)
        if p < len(item):
            now[1:] = np.where(text == item[p], before[:-1] + 1, 0)
        # a run ends where the next row doesn't carry it on
        length = before.copy()
        length[:-1][now[1:] > 0] = 0
        end = np.flatnonzero(length >= least)
        out.append((p - length[end], end - length[end], length[end]))
        before = now
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def tile(item: np.ndarray, text: np.ndarray, runs: tuple[np.ndarray, np.ndarray, np.ndarray], least: int) -> list[tuple[int, int, int]]:
    """Tiles (first in item, first in text, length), longest first; of equal length the first in the item, then in the text."""
    used_p, used_t, left = np.zeros(len(item), bool), np.zeros(len(text), bool), len(item)
    heap = [(-n, p, t) for p, t, n in zip(*(x.tolist() for x in runs), strict=True)]
    heapq.heapify(heap)
    out = []
    while heap and left >= least:
        n, p, t = heapq.heappop(heap)
        n = -n
        taken = used_p[p : p + n] | used_t[t : t + n]
        if not taken.any():
            out.append((p, t, n))
            used_p[p : p + n] = used_t[t : t + n] = True
            left -= n
            continue
        edge = np.diff(np.r_[1, taken, 1])  # what is left of it competes again
        for at, end in zip(np.flatnonzero(edge == -1).tolist(), np.flatnonzero(edge == 1).tolist(), strict=True):
            if end - at >= least:
                heapq.heappush(heap, (at - end, p + at, t + at))
    return out


#: Seeds of one text that are listed at once; items with more are swept.
MOST_SEEDS = 1 << 21


@dataclass
class Index:
    """Benchmark items: their token ids, the vocabulary, and sorted seeds with the (item, position) of each."""

    vocab: dict[str, int]
    names: list[int | None]
    items: list[np.ndarray]
    flat: np.ndarray  # all items, one after the other
    begin: np.ndarray
    seeds: np.ndarray
    owner: np.ndarray
    at: np.ndarray
    least: int
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by length: the seeds of the items of fewer tokens, sorted, and their owners

    def matches(self, text: str | None, coverage: float) -> list[tuple[int | None, float, list[tuple[int, int, int]]]]:
        """(item_id, coverage, tiles) of the items that the text covers so far, in item order."""
        words = tokens(text)
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        found = self._whole(ids)
        for own, runs in self._runs(ids).items():
            tiles = tile(self.items[own], ids, runs, self.least)
            share = sum(n for _, _, n in tiles) / len(self.items[own])
            if share >= coverage:
                found[own] = (self.names[own], share, tiles)
        return [found[own] for own in sorted(found)]

    def _seeded(self, ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all runs of n known tokens."""
        if len(ids) < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        place = np.flatnonzero(np.convolve(ids >= 0, np.ones(n, dtype=np.int64), "valid") == n)
        codes = np.zeros(len(place), np.uint64)
        for k in range(n):
            codes = codes * _BASE + ids[place + k].astype(np.uint64) + np.uint64(1)
        return place, codes

    def _whole(self, ids: np.ndarray) -> dict[int, tuple[int | None, float, list[tuple[int, int, int]]]]:
        """The items of fewer than `least` tokens, at their first place."""
        out: dict = {}
        for n, (seeds, owner) in self.short.items():
            place, codes = self._seeded(ids, n)
            lo, hi = np.searchsorted(seeds, codes, "left"), np.searchsorted(seeds, codes, "right")
            for t, a, b in zip(place[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist(), strict=True):
                for own in owner[a:b].tolist():
                    if own not in out and np.array_equal(self.items[own], ids[t : t + n]):
                        out[own] = (self.names[own], 1.0, [(0, t, n)])
        return out

    def _runs(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By item, its maximal runs in the text."""
        place, codes = self._seeded(ids, self.least)
        lo, hi = np.searchsorted(self.seeds, codes, "left"), np.searchsorted(self.seeds, codes, "right")
        n = hi - lo
        if not n.any():
            return {}
        if int(n.sum()) > MOST_SEEDS:  # a text and items that repeat themselves: a list of seeds is the product of both
            owners = {int(x) for a, b in {*zip(lo[n > 0].tolist(), hi[n > 0].tolist(), strict=True)} for x in self.owner[a:b]}
            runs = {own: swept(self.items[own], ids, self.least) for own in owners}
            return {own: r for own, r in runs.items() if len(r[0])}
        k = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        t, own, p = np.repeat(place, n), self.owner[k], self.at[k]
        # equal hashes are held against the tokens themselves
        same = np.ones(len(t), bool)
        for j in range(self.least):
            same &= self.flat[self.begin[own] + p + j] == ids[t + j]
        t, own, p = t[same], own[same], p[same]
        return {int(o): diagonals(p[own == o], t[own == o], self.least) for o in np.unique(own)}


def build(rows: list[tuple[int | None, str | None]], least: int = LEAST) -> Index:
    """Null items and those without tokens match nothing."""
    vocab: dict[str, int] = {}
    items = [np.array([vocab.setdefault(w, len(vocab)) for w in tokens(text)], dtype=np.int64) for _, text in rows]
    seeds = [rolling(x, least) for x in items]
    code = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
    order = np.argsort(code, kind="stable")
    size = np.array([len(s) for s in seeds], dtype=np.int64)
    owner = np.repeat(np.arange(len(items)), size)
    at = np.concatenate([np.arange(n) for n in size]) if seeds else np.zeros(0, np.int64)
    long = np.array([len(x) for x in items], dtype=np.int64)
    short = {}
    for n in range(1, least):
        if own := [i for i, x in enumerate(items) if len(x) == n]:
            codes = np.concatenate([rolling(items[i], n) for i in own])
            by = np.argsort(codes, kind="stable")
            short[n] = (codes[by], np.array(own)[by])
    return Index(vocab, [n for n, _ in rows], items, np.concatenate([*items, np.zeros(0, np.int64)]), np.cumsum(long) - long, code[order], owner[order], at[order], least, short)


def indexes(benchmark: DataFrame, least: int = LEAST, block_bytes: int = 16_000_000) -> Iterator[Index]:
    """The benchmark in blocks of bounded size, each small enough to send to every executor; equal rows count once. The driver holds one block at a time."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").distinct().orderBy("item_id", "text").toLocalIterator():
        rows.append((r["item_id"], r["text"]))
        size += len((r["text"] or "").encode())
        if size >= block_bytes:
            yield build(rows, least)
            rows, size = [], 0
    if rows:
        yield build(rows, least)


PAIRS = "doc_id long, item_id long, coverage double, tiles array<struct<item_at:int,doc_at:int,length:int>>"


def _in_turn(docs: DataFrame, found: Iterator[Index], rows, schema: str) -> DataFrame:
    """The union of one pass over docs for each block; rows(index) makes a pass's function of batches. All passes but the last are
    written before the next block is read, so that one broadcast is alive at a time."""
    spark = docs.sparkSession
    done, found = [], iter(found)
    block = next(found, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)
        part = arrow_map(docs, rows(shared), schema)
        block = next(found, None)
        if block is not None:
            part = cut(part, "block")
            shared.destroy()
        done.append(part)
    out = spark.createDataFrame([], schema) if not done else done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def leaks(docs: DataFrame, found: Iterator[Index], coverage: float = COVERAGE) -> DataFrame:
    """One row for each document and item it covers: doc_id, item_id, coverage, tiles (in tokens). Whole texts; no shuffle.

    Null and empty texts cover nothing; repeated rows give repeated results; a benchmark without rows gives none.
    """

    def rows(shared):
        def run(batch) -> dict:
            got: dict = {"doc_id": [], "item_id": [], "coverage": [], "tiles": []}
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for name, share, tiles in shared.value.matches(text, coverage):
                    got["doc_id"].append(doc_id)
                    got["item_id"].append(name)
                    got["coverage"].append(share)
                    got["tiles"].append([{"item_at": p, "doc_at": t, "length": n} for p, t, n in tiles])
            return got

        return run

    return _in_turn(docs.select("doc_id", "text"), found, rows, PAIRS)


def clean(docs: DataFrame, found: Iterator[Index], coverage: float = COVERAGE) -> DataFrame:
    """docs, all columns, without the documents that cover an item.

    One block of items: one pass without a shuffle. More: a pass for each that gives the hashes (128 bits) of the texts
    that go, and one join.
    """
    found = iter(found)
    first, second = next(found, None), next(found, None)
    if first is None:
        return docs
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first)

        def run(batches):
            for batch in batches:
                keep = [not shared.value.matches(t.as_py(), coverage) for t in batch.column("text")]
                yield batch.filter(pa.array(keep, type=pa.bool_()))
            release()

        return docs.mapInArrow(run, docs.schema)

    def rows(shared):
        def run(batch) -> dict:
            gone = pa.array([bool(shared.value.matches(t, coverage)) for t in batch.column("text").to_pylist()], type=pa.bool_())
            return {"k1": batch.column("h1").filter(gone), "k2": batch.column("h2").filter(gone)}

        return run

    def blocks():
        yield first
        yield second
        yield from found

    h1, h2 = (unique_name(docs.columns, f"__{x}") for x in ("h1", "h2"))
    hashed = lambda seed: F.xxhash64(F.lit(seed), F.coalesce("text", F.lit("")))
    gone = _in_turn(docs.select(hashed(29).alias("h1"), hashed(31).alias("h2"), "text"), blocks(), rows, "k1 long, k2 long").distinct().toDF(h1, h2)
    return docs.withColumns({h1: hashed(29), h2: hashed(31)}).join(gone, [h1, h2], "left_anti").select(docs.columns)


def op4_tiling_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item it covers by half or more: doc_id, item_id, coverage, tiles (see leaks for odd rows)."""
    return leaks(read(spark, sf_dir, "documents"), indexes(read(spark, sf_dir, "benchmark")))
