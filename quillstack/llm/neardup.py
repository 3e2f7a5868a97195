"""Near duplicates by BagMinHash: weighted-Jaccard signatures, bands, exact multiset overlap, components.

A text is the multiset of its five-word shingles. Each shingle of count w has a Poisson process over the weights
0..w for each doubling of the weight ([0,1), [1,2), [2,4), ...); a point has a time, one of `m` slots and a weight, and
counts if that weight is below w. A slot's signature is its earliest point, so two signatures agree there with the
probability of the weighted Jaccard similarity. Points come in order of time, and a text stops at its latest slot.

Documents meet in bands of `rows` slots. In each band all members are compared with the one that meets most neighbours,
then those still apart with a second leader, then every pair of members from different classes, in blocks that give
back verified links alone, one for each member and class; no bucket is cut off. Candidates are always
verified on the whole multisets themselves. Links go through alternating stars to class ids. Everything that grows with
the corpus stays in DataFrames. Hot texts are one node; hot bands are summed before they shuffle, and what is joined back
to them is a written table, so that Spark can split a hot band's members over tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import arrow_map, cut, drop, marked, marks, read, unique_name
from quillstack.llm.graph import components
from quillstack.llm.langid import letter_table

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 30, 5
_B, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: list[np.ndarray] = []
_word_chars: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        inverse = np.uint64(pow(int(_B), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(n, b, dtype=np.uint64)]) for b in (_B, inverse)]
    return _powers[0], _powers[1]


def _word_char_table() -> np.ndarray:
    if not _word_chars:
        digits = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), dtype=bool, count=0x110000)
        _word_chars.append(digits | letter_table())
    return _word_chars[0]


def shingles(texts: list[str | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 48-bit shingle), sorted, with repeats. Words are runs of letters, digits and _, in lower case.

    A text of fewer than n words is one shingle of them all; one without words has none.
    """
    lower = [(t or "").lower() for t in texts]
    cp = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter(map(len, lower), dtype=np.int64, count=len(lower)) + 1)
    inside = _word_char_table()[cp]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _power_tables(len(cp) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(cp.astype(np.uint64) * power[: len(cp)])]
    word = mix((sums[end] - sums[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    doc = np.searchsorted(ends, begin, side="right")
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    if len(word) >= n:
        code = word[: len(word) - n + 1].copy()
        for k in range(1, n):
            code = code * _B + word[k : len(word) - n + 1 + k]
        own = doc[: len(code)] == doc[n - 1 :]
        codes, docs = mix(code[own]), doc[: len(code)][own]
    else:
        codes, docs = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        short = np.zeros(len(few), np.uint64)
        for k in range(n - 1):
            more = count[few] > k
            short[more] = short[more] * _B + word[first[few[more]] + k]
        codes, docs = np.r_[codes, mix(short + np.uint64(1))], np.r_[docs, few]
    keys = np.sort((docs.astype(np.uint64) << np.uint64(48)) | (codes >> np.uint64(16)))
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1)


def bag_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS, seed: int = 1) -> np.ndarray:
    """(n_docs x m) signatures of integer-weighted sets; rows without elements stay infinite."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level == 0, 0.0, np.exp2(level - 1.0))
    long = np.where(level == 0, 1.0, np.exp2(np.maximum(level - 1.0, 0.0)))
    d, w, t = doc[of], weight[of].astype(np.float64), np.zeros(len(of))
    state = mix(element[of] * _M1 + level.astype(np.uint64) * _M2 + np.uint64(seed))
    sig = np.full((n_docs, m), np.inf)
    flat, limit = sig.reshape(-1), np.full(n_docs, np.inf)
    while len(d):
        state = state + _B
        z = mix(state)
        t = t - np.log1p(-((z >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / long
        live = t < limit[d]
        d, w, t, low, long, state = d[live], w[live], t[live], low[live], long[live], state[live]
        z = mix(z[live] ^ _B)
        slot = ((z >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        counts = low + (z & np.uint64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32 * long < w
        np.minimum.at(flat, d[counts] * m + slot[counts], t[counts])
        touched = np.unique(d) if len(d) < n_docs else np.arange(n_docs)
        limit[touched] = sig[touched].max(axis=1)
    return sig


def _weighted(doc: np.ndarray, element: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    new = np.r_[True, (element[1:] != element[:-1]) | (doc[1:] != doc[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    return doc[at], element[at], np.diff(np.r_[at, len(doc)])


def _chunks(texts: list[str | None], chars: int = 400_000) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and end - at < 4096 and (end == at or size < chars):
            size += len(texts[end] or "")
            end += 1
        out.append((at, end))
        at = end
    return out


def _signed(texts: list[str | None]) -> np.ndarray:
    parts = [bag_minhash(*_weighted(*shingles(texts[a:b])), b - a) for a, b in _chunks(texts)]
    return np.concatenate(parts) if parts else np.zeros((0, BANDS * ROWS))


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(texts x bands) hashes of each band's slots and number."""
    bits = np.ascontiguousarray(sig).view(np.uint64).reshape(len(sig), bands, rows)
    out = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for k in range(rows):
        out = mix(out * _B + bits[:, :, k])
    return out.view(np.int64)


def bags(texts: list[str | None]) -> list[bytes]:
    """Each text's multiset as sorted 64-bit marks of (shingle, occurrence): plain set overlap of marks is multiset overlap."""
    out: list[bytes] = []
    for a, b in _chunks(texts):
        doc, element = shingles(texts[a:b])
        _, _, n = _weighted(doc, element)
        turn = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.uint64)
        mark = mix(element * _M1 + turn * _M2 + np.uint64(5))
        mark = mark[np.lexsort((mark, doc))]
        bound = np.searchsorted(doc, np.arange(b - a + 1))
        out += [mark[i:j].tobytes() for i, j in zip(bound, bound[1:], strict=False)]
    return out


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard of two bags; two empty ones are equal."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if len(x) > len(y):
        x, y = y, x
    if not len(y):
        return 1.0
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both / (len(x) + len(y) - both)


def overlaps(left: list[bytes], right: list[bytes], names_at_once: int | None = None) -> np.ndarray:
    """Exact similarities of all pairs of two lists of bags, over so many different marks at once."""
    names_at_once = names_at_once or max(256, (1 << 23) // (len(left) + len(right)))
    own = [np.frombuffer(b, np.uint64) for b in (*left, *right)]
    size, n = np.array([len(b) for b in own]), len(left)
    mark, row = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    order = np.argsort(mark, kind="stable")
    mark, row = mark[order], row[order]
    name = np.cumsum(np.r_[False, mark[1:] != mark[:-1]]) if len(mark) else np.zeros(0, np.int64)
    # marks of one side alone are in no overlap
    kinds = int(name[-1]) + 1 if len(name) else 0
    shared = (np.bincount(name[row < n], minlength=kinds) > 0) & (np.bincount(name[row >= n], minlength=kinds) > 0)
    keep = shared[name] if len(name) else np.zeros(0, bool)
    name, row = (np.cumsum(shared) - 1)[name[keep]] if len(name) else name, row[keep]
    both = np.zeros((n, len(right)), dtype=np.float64)
    for lo in range(0, int(shared.sum()), names_at_once):
        a, b = np.searchsorted(name, (lo, lo + names_at_once))
        there = np.zeros((len(own), names_at_once), dtype=np.float32)
        there[row[a:b], name[a:b] - lo] = 1
        both += there[:n] @ there[n:].T
    return both / np.maximum(size[:n, None] + size[None, n:] - both, 1)


class NearDuplicates:
    """Steps over docs(doc_id, text). Exact copies are one node: texts are told apart by 128 bits of hash (h1, h2), and each
    different text has a number `node`, given when the table of nodes is written."""

    def __init__(self, docs: DataFrame, least: float = SIMILARITY):
        self.least = least
        self.texts = keyed(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))

        def rows(batch) -> dict:
            sig = _signed(batch.column("text").to_pylist())
            # a text without words has no points and meets no other; its copies are its node already
            bare = np.isinf(sig).all(axis=1)
            return {"h1": batch.column("h1"), "h2": batch.column("h2"), "doc_id": batch.column("doc_id"), "bands": [k[:0] if b else k for k, b in zip(band_keys(sig), bare, strict=True)]}

        signed = arrow_map(self.texts, rows, "h1 long, h2 long, doc_id long, bands array<long>")
        one = signed.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("exact"), F.first("bands").alias("bands"))
        self.nodes = cut(one.withColumn("node", F.monotonically_increasing_id()), "nodes")
        members = self.nodes.select("node", F.explode("bands").alias("band"))
        shared = cut(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "shared")
        met = cut(members.join(shared, "band").select("band", "node", "size"), "met")
        drop(shared)
        # a text that others were copied from keeps the smallest points of all of them, so it meets most neighbours
        weight = cut(met.groupBy("node").agg(F.sum("size").alias("weight")), "weight")
        leaders = cut(met.join(weight, "node").groupBy("band").agg(F.max_by("node", F.struct("weight", "node")).alias("leader")), "leaders")
        self.banded = cut(met.join(leaders, "band").select("band", "node", "leader", "size"), "banded")
        wanted = self.nodes.select("node", "h1", "h2", "rep").join(weight.select("node"), "node")
        # a bitmap of fixed size tells most texts that meet no other before they would be moved; copies go by their own ids
        bits = marks(wanted.select("h1"))
        near = marked(self.texts, bits).withColumnsRenamed({"h1": "t1", "h2": "t2", "doc_id": "own"})
        chosen = near.join(wanted, (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2")) & F.col("own").eqNullSafe(F.col("rep"))).select("node", "text")

        def packed(batch) -> dict:
            return {"node": batch.column("node"), "bag": bags(batch.column("text").to_pylist())}

        self.bags = cut(arrow_map(chosen, packed, "node long, bag binary").dropDuplicates(["node"]), "bags")
        drop(met, weight, leaders)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity) of the pairs that reach the similarity, from their multisets."""
        least = self.least
        left, right = self.bags.toDF("a", "bag_a"), self.bags.toDF("b", "bag_b")
        joined = pairs.distinct().join(left, "a").join(right, "b")

        def rows(batch) -> dict:
            a, b = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            share = np.array([similarity(x.as_py(), y.as_py()) for x, y in zip(batch.column("bag_a"), batch.column("bag_b"), strict=True)])
            keep = share >= least
            return {"a": a[keep], "b": b[keep], "similarity": share[keep]}

        return arrow_map(joined.select("a", "bag_a", "b", "bag_b"), rows, "a long, b long, similarity double")

    def _mixed(self, classes: DataFrame) -> DataFrame:
        """Members (band, node, class, size) of the bands that still hold more than one class."""
        now = self.banded.join(classes, "node", "left").select("band", "node", F.coalesce("class", "node").alias("class"))
        several = cut(now.groupBy("band").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.count("*").alias("size")).where("lo <> hi").select("band", "size"), "several")
        mixed = cut(now.join(several, "band"), "mixed")
        drop(several)
        return mixed

    def classes(self) -> DataFrame:
        """(node, class) of linked nodes: verified links connect whatever shares a band, within and between all classes."""
        first = cut(self.verified(self.banded.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b"))), "first")
        classes = components(first.select("a", "b"))
        mixed = self._mixed(classes)
        second = cut(mixed.groupBy("band").agg(F.min(F.struct(F.xxhash64("node", "band"), "node", "class")).alias("to")), "second")
        pairs = mixed.join(second, "band").where("class <> to.class").select(F.least("node", "to.node").alias("a"), F.greatest("node", "to.node").alias("b"))
        more = cut(self.verified(pairs), "more")
        drop(second, mixed, classes)
        found = first.union(more).select("a", "b")
        classes = components(found)
        mixed = self._mixed(classes)
        rest = cut(self.verified(self._few_apart(mixed)).union(self._many_apart(mixed)), "rest")
        drop(mixed)
        if rest.isEmpty():
            drop(first, more, rest)
            return classes
        drop(classes)
        classes = components(found.union(rest.select("a", "b")))
        drop(first, more, rest)
        return classes

    def _few_apart(self, mixed: DataFrame, small: int = 12) -> DataFrame:
        """All pairs (a, b) of different classes in bands of at most `small` members."""
        few = mixed.where(F.col("size") <= small).groupBy("band").agg(F.array_sort(F.collect_list(F.struct("node", "class"))).alias("all"))
        pairs = few.select(F.explode(F.expr("flatten(transform(all, (x, i) -> transform(filter(slice(all, i + 2, size(all)), y -> y.class <> x.class), y -> struct(x.node as a, y.node as b))))")).alias("p")).select("p.a", "p.b")
        return pairs

    def _many_apart(self, mixed: DataFrame, small: int = 12, block: int = 1024, block_bytes: int = 32_000_000) -> DataFrame:
        """Links (a, b, similarity) between classes in larger bands, one for each member and other class of a pair of blocks.

        Blocks are bounded by members and by bytes of bags; a bag is sent once for each block of its band.
        """
        least = self.least
        many = mixed.where(F.col("size") > small)
        weighed = many.join(self.bags.select("node", F.octet_length("bag").alias("weight")), "node").groupBy("band").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("weight") / block_bytes)).cast("int").alias("blocks"))
        many = many.join(weighed, "band")
        many = many.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        members = many.join(self.nodes.select("node", "bands"), "node").join(self.bags, "node")
        dealt = members.select("band", "node", "class", "bands", "bag", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        dealt = dealt.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            """A pair is looked at in the first of the bands it shares, so once."""
            lo, hi, band = int(group["lo"].iloc[0]), int(group["hi"].iloc[0]), int(group["band"].iloc[0])
            x, y = group[group["own"] == lo], group[group["own"] == hi]
            if not len(x) or not len(y):
                return pd.DataFrame({"a": [], "b": [], "similarity": []}).astype({"a": "int64", "b": "int64"})
            kx, ky = np.stack(x["bands"]), np.stack(y["bands"])
            earlier = int(np.flatnonzero(kx[0] == band)[0])
            cx, cy = x["class"].to_numpy(), y["class"].to_numpy()
            apart = cx[:, None] != cy[None, :]
            if lo == hi:
                apart = np.triu(apart, 1)
            for k in range(earlier):
                apart &= kx[:, k][:, None] != ky[:, k][None, :]
            share = overlaps(x["bag"].tolist(), y["bag"].tolist()) if apart.any() else np.zeros(apart.shape)
            nx, ny, done, out = x["node"].to_numpy(), y["node"].to_numpy(), set(), []
            for i, j in zip(*np.nonzero(apart & (share >= least)), strict=True):
                if (nx[i], cy[j]) in done or (ny[j], cx[i]) in done:
                    continue
                done |= {(nx[i], cy[j]), (ny[j], cx[i])}
                out.append((min(nx[i], ny[j]), max(nx[i], ny[j]), share[i, j]))
            return pd.DataFrame(out, columns=["a", "b", "similarity"]).astype({"a": "int64", "b": "int64", "similarity": "float64"})

        return dealt.groupBy("band", "lo", "hi").applyInPandas(compare, "a long, b long, similarity double")


def keyed(docs: DataFrame, text: str = "text", h1: str = "h1", h2: str = "h2") -> DataFrame:
    """docs with 128 bits of hash of the text (null: empty)."""
    whole = F.coalesce(text, F.lit(""))
    return docs.withColumns({h1: F.xxhash64(F.lit(29), whole), h2: F.xxhash64(F.lit(31), whole)})


def near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (the class's least doc_id), keep (whether it is the row that stays), exact (copies of its text),
    texts (different ones in its class), h1 and h2 (its text's hash), class (a number; classes may share their least doc_id).

    Null and empty texts count as copies of one another; other texts without words are like equal ones only. Null ids sort
    last; of rows with the kept id one stays. Texts of any length are compared whole. An empty table gives no rows.
    """
    steps = NearDuplicates(docs, least)
    classes = steps.classes()
    named = steps.nodes.select("node", "h1", "h2", "rep", "exact").join(classes, "node", "left").withColumn("class", F.coalesce("class", "node")).drop("node")
    # a text alone in its class needs no other row to know its class's least id
    heads = classes.join(steps.nodes.select("node", "rep"), "node").groupBy("class").agg(F.min("rep").alias("least"), F.count("*").alias("texts"))
    named = named.join(heads, "class", "left").withColumns({"class_id": F.when(F.col("texts").isNull(), F.col("rep")).otherwise(F.col("least")), "texts": F.coalesce("texts", F.lit(1))})
    known = named.select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "class", "class_id", "exact", "texts")
    # exact copies of one text may be a third of all rows; their ids are all that is moved
    rows = steps.texts.select("doc_id", "h1", "h2").join(cut(known, "known"), (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")))
    return rows.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("keep"), "exact", "texts", "h1", "h2", "class")


def drop_near_duplicates(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with one row of each class: the one with the least id; of rows equal in id and text one stays.

    Extra columns stay as they are and may have any name.
    """
    steps = NearDuplicates(docs.select("doc_id", "text"), least)
    classes = steps.classes()
    # of each class one node, by least id (null last) and number
    rank = F.struct(F.col("rep").isNull().alias("none"), "rep", "node")
    heads = classes.join(steps.nodes.select("node", "rep"), "node").groupBy("class").agg(F.min(rank).alias("head"))
    linked = classes.join(heads, "class").where(F.col("node") != F.col("head.node")).select("node")
    kept = steps.nodes.join(linked, "node", "left_anti").select("h1", "h2", "rep", "exact")
    names = {c: unique_name(docs.columns, f"__{c}") for c in ("h1", "h2", "k1", "k2", "rep", "exact")}
    kept = cut(kept.select(F.col("h1").alias(names["k1"]), F.col("h2").alias(names["k2"]), F.col("rep").alias(names["rep"]), F.col("exact").alias(names["exact"])), "kept")
    own = keyed(docs, "text", names["h1"], names["h2"])
    same = (F.col(names["h1"]) == F.col(names["k1"])) & (F.col(names["h2"]) == F.col(names["k2"])) & F.col("doc_id").eqNullSafe(F.col(names["rep"]))
    left = own.join(kept, same)
    # only a text with copies can be there twice with its kept id; most corpora have no such rows
    copies = own.select("doc_id", names["h1"], names["h2"]).join(kept.where(F.col(names["exact"]) > 1), same).groupBy(names["k1"], names["k2"]).agg(F.count("*").alias("n")).where("n > 1")
    if cut(copies, "repeated").isEmpty():
        return left.select(docs.columns)
    alone = left.where(F.col(names["exact"]) == 1).select(docs.columns)
    return alone.unionByName(left.where(F.col(names["exact"]) > 1).dropDuplicates([names["k1"], names["k2"]]).select(docs.columns))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, class_id, keep, exact, texts (see near_duplicates for nulls, empty texts, ties and repeated rows)."""
    return near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("h1", "h2", "class")
