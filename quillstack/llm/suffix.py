"""Suffix-array dedup: repeated byte strings from merged Burrows-Wheeler transforms.

A byte goes if a string of `length` bytes that covers it also starts in a document with a smaller id. The work in steps,
none of which holds more than a bounded part of the corpus:

1. Texts are dealt to parts by id. Each part marks, for every `length`-byte window, its leftmost least k-gram (the
   window's anchor; equal windows have equal anchors) and sends the distinct anchors' hashes to buckets by hash.
2. A bucket tells each part which anchors other documents have too. Only windows with such an anchor can repeat.
3. Windows with one anchor form a stretch of under 2 * length bytes. A part sends each distinct stretch once, with its
   least id, to the anchor's bucket. Anchors in very many stretches send single windows by the windows' own hash.
   Equal stretches are one string there; a string alone with its anchor has nothing to be compared with.
4. A bucket cuts the other distinct stretches into shards, sorts each shard's rotations once and keeps only the Burrows-Wheeler
   transforms. It merges all of them by iterative interleave refinement: an interleave of shard numbers is sorted again
   and again by the transforms' own symbols; after iterations worth `length` symbols, positions that were never told
   apart have that common prefix, and these intervals are the repeated strings. No suffix is sorted again.
5. Each interval's least id goes back to the parts that sent its windows; a part removes what it covers.

Equal strings always meet: windows decide their own anchor and bucket. Hashes only choose where strings meet and, on
the way back, name a stretch within its part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm.common import even_keys, parts, read
from quillstack.llm.neardup import mix

LENGTH, GRAM = 50, 20
SPAN = LENGTH - GRAM + 1
#: An anchor in more stretches of one corpus than this is dealt by single windows.
HOT = 4096
#: Buckets of stretches for each part, so that a bucket's arrays stay small.
SPREAD = 4
#: Bytes of text in a part, so that a task's memory is bounded whatever the cluster's number of shuffle partitions.
PART_BYTES = 128_000_000
_C1, _C2, _C3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_LAST = np.iinfo(np.int64).max  # stands for a null id, which is larger than any other


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one text: first window, one past the last window and anchor hash of each stretch, in order."""
    n = len(raw) - length + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    buf = raw + bytes(8)
    eight = np.ndarray((len(raw),), dtype="<u8", buffer=buf, strides=(1,))
    grams = len(raw) - gram + 1
    h = np.full(grams, np.uint64(gram), dtype=np.uint64)
    for at in range(0, gram, 8):
        word = eight[at : at + grams]
        if gram - at < 8:
            word = word & np.uint64((1 << 8 * (gram - at)) - 1)
        h = (h ^ word) * _C1
        h ^= h >> np.uint64(29)
    h *= _C2
    # hash above, place below: the least is the least hash and of equal ones the leftmost
    bits = np.uint64(max(28, int(grams).bit_length()))  # the same for all texts but those beyond 2**28 bytes
    key = (h >> bits << bits) | np.arange(grams, dtype=np.uint64)
    span, best, width = length - gram + 1, key, 1
    while width * 2 <= span:
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    if width < span:
        best = np.minimum(best[: n], best[span - width : span - width + n])
    place = best[:n] & np.uint64((1 << int(bits)) - 1)
    cut = np.flatnonzero(place[1:] != place[:-1]) + 1
    begin = np.r_[0, cut]
    return begin, np.r_[cut, n], mix(h[place[begin].astype(np.int64)])


def _blocks(texts: list[bytes], size: int = 1 << 18) -> list[tuple[int, int]]:
    out, at = [], 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n < size):
            n += len(texts[end])
            end += 1
        out.append((at, end))
        at = end
    return out


class Part:
    """The stretches of one part's texts, in order of id: flat bytes, and of each stretch document, begin, end (of its windows) and anchor."""

    def __init__(self, ids: np.ndarray, texts: list[str | None]):
        raw = [(t or "").encode() for t in texts]
        order = np.argsort(ids, kind="stable")
        self.ids, self.raw = ids[order], [raw[i] for i in order]
        self.order = order
        size = np.fromiter(map(len, self.raw), dtype=np.int64, count=len(self.raw))
        self.base = np.cumsum(size) - size
        self.flat = np.frombuffer(b"".join(self.raw), dtype=np.uint8)
        begin, end, code, doc = [], [], [], []
        for a, b in _blocks(self.raw):
            # texts of a block in one array; stretches never cross a text since each text's windows stand alone
            joined, first = b"".join(self.raw[a:b]), self.base[a]
            if b - a == 1:
                s, e, c = anchors(joined)
                begin.append(s + first)
                end.append(e + first)
                code.append(c)
                doc.append(np.full(len(s), a))
                continue
            s, e, c = anchors(joined)
            s, e = s + first, e + first
            own = np.searchsorted(self.base, s, side="right") - 1
            last = np.searchsorted(self.base, e - 1, side="right") - 1
            over = np.flatnonzero(last > own)  # split where a text ends
            if len(over):
                extra = [(k, d) for k in over.tolist() for d in range(int(own[k]) + 1, int(last[k]) + 1)]
                which, d = np.array([x[0] for x in extra]), np.array([x[1] for x in extra])
                s2, e2, c2 = self.base[d], np.minimum(e[which], self.base[d] + size[d]), c[which]
                s, e, c, own = np.r_[s, s2], np.r_[e, e2], np.r_[c, c2], np.r_[own, d]
                by = np.argsort(s, kind="stable")
                s, e, c, own = s[by], e[by], c[by], own[by]
            e = np.minimum(e, self.base[own] + size[own] - LENGTH + 1)
            keep = s < e
            begin.append(s[keep])
            end.append(e[keep])
            code.append(c[keep])
            doc.append(own[keep])
        join = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
        self.begin, self.end, self.code, self.doc = join(begin, np.int64), join(end, np.int64), join(code, np.uint64), join(doc, np.int64)

    def names(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the bytes begin..end of each, from running sums over pieces of the part."""
        out, by = np.empty(len(begin), np.uint64), np.argsort(begin, kind="stable")
        power, inverse = _tables()
        for at in range(0, len(self.flat), PIECE):
            own = by[np.searchsorted(begin, at, sorter=by) : np.searchsorted(begin, at + PIECE, sorter=by)]
            if len(own):
                piece = self.flat[at : at + PIECE + 4 * LENGTH].astype(np.uint64) + np.uint64(1)
                sums = np.r_[np.uint64(0), np.cumsum(piece * power[: len(piece)])]
                a, b = begin[own] - at, end[own] - at
                # as if the first byte stood at place 0
                out[own] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _C3)
        return out


PIECE = 1 << 18
_sums: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    if not _sums:
        back = np.uint64(pow(int(_C1), -1, 1 << 64))
        _sums[:] = [np.cumprod(np.r_[np.uint64(1), np.full(PIECE + 4 * LENGTH, x, dtype=np.uint64)]) for x in (_C1, back)]
    return _sums


def _bucket(code: np.ndarray, buckets: int) -> np.ndarray:
    return (code % np.uint64(buckets)).astype(np.int64)


def _distinct(code: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct codes sorted, each row's index in them, number of rows of each, whether it is in several documents)."""
    codes, back, n = np.unique(code, return_inverse=True, return_counts=True)
    last = np.zeros(len(codes), np.int64)
    last[back] = doc
    first = np.zeros(len(codes), np.int64)
    first[back[::-1]] = doc[::-1]
    return codes, back, n, first != last


def _grouped(key: np.ndarray) -> list[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    cut = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, int)
    return [(int(key[order[a]]), order[a:b]) for a, b in zip(cut.tolist(), np.r_[cut[1:], len(key)].tolist(), strict=True)]


def _flat(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = np.cumsum(size)
    return data[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


def rotations(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions in the order of their strings' rotations. text: symbols, each string ended by a 0 that stands once in it."""
    n = len(text)
    own = np.repeat(np.arange(len(first)), size)
    start, long = first[own], size[own]
    at = np.arange(n) - start

    def ahead(step: int) -> np.ndarray:
        to = at + step
        if step > 2 * int(size.min()):
            return start + to % long
        for _ in range(-(-step // int(size.min()))):  # cheaper than a division
            np.subtract(to, long, out=to, where=to >= long)
        return start + to

    rank = text.astype(np.uint64)
    width = 1
    for _ in range(3):  # eight symbols of at most eight bits
        rank = (rank << np.uint64(8 * width)) | rank[ahead(width)]
        width *= 2
    order = np.argsort(rank)
    while True:
        same = np.r_[False, rank[order][1:] == rank[order][:-1]]
        new = np.empty(n, np.uint64)
        new[order] = np.cumsum(~same) - 1
        if not same.any() or width > 2 * int(size.max()):
            return order
        rank = (new << np.uint64(32)) | new[ahead(width)]
        width *= 2
        order = np.argsort(rank)


def merge(at: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the shards' transforms after one refinement a step, and where a new interval starts: of the rotations `at`, moved back.

    A step has of each rotation, one shard's after another's in their order, the Burrows-Wheeler transform's symbol, which is so many
    preceding bytes, and the rotation that starts there. The interleave starts unsorted, one shard after another; each iteration moves
    every position to the place its preceding symbol gives it, keeping order among equal symbols. Afterwards positions are sorted by as
    many bytes as all steps' symbols have, and those told apart differ within them. A position alone in its interval stays alone as it
    moves back, and so is left out of what is returned and of what is sorted once there are many of these.
    """
    opened = np.zeros(len(at), bool)
    opened[:1] = True
    for symbols, back in steps:
        if not len(at):
            break
        symbol = symbols[at]
        block = np.cumsum(opened, dtype=np.int32)
        to = np.argsort(symbol, kind="stable")
        moved, s, at = block[to], symbol[to], back[at[to]]
        opened = np.r_[True, (s[1:] != s[:-1]) | (moved[1:] != moved[:-1])]
        several = ~(opened & np.r_[opened[1:], True])
        if 8 * np.count_nonzero(several) < 7 * len(at):
            at, opened = at[several], opened[several]
    return at, opened


def repeats(strings: list[bytes], least: np.ndarray, depth: int = LENGTH, shard_bytes: int = 1 << 19) -> list[np.ndarray]:
    """For each distinct string, the least id among all strings that hold the same `depth` bytes, by position.

    Strings are cut into shards of bounded size (two at least), each sorted by itself; the shards' transforms are merged.
    """
    if not strings:
        return []
    size = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings)) + 1
    raw = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8)
    text = np.empty(len(raw), np.uint8)
    first = np.cumsum(size) - size
    used = np.zeros(256, bool)
    body = np.ones(len(raw), bool)
    body[first + size - 1] = False
    used[raw[body]] = True
    # symbols 1..; UTF-8 never uses all byte values, so 0 is free for the ends
    names = np.cumsum(used).astype(np.uint8)
    text[:] = np.where(body, names[raw], 0)
    share = max(1, min(shard_bytes, -(-len(raw) // 2)))
    shard = np.minimum(first // share, (len(raw) - 1) // share)
    orders = []
    for _, members in _grouped(shard):
        lo, hi = int(first[members[0]]), int(first[members[-1]] + size[members[-1]])
        orders.append(rotations(text[lo:hi], first[members] - lo, size[members]) + lo)

    def before(x: np.ndarray) -> np.ndarray:
        """Of each place the value at the one before it in its string's rotation."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[first] = x[first + size - 1]
        return out

    last, base = before(text), int(used.sum()) + 1

    def longer(name: np.ndarray) -> np.ndarray | None:
        """Names of one byte more, in the same order; None if 16 bits can't name them."""
        wide = before(name).astype(np.int32) * base + last
        seen = np.zeros((int(name.max()) + 1) * base, bool)
        seen[wide] = True
        known = np.flatnonzero(seen)
        if len(known) > 1 << 16:
            return None
        names = np.empty(len(seen), np.uint16)
        names[known] = np.arange(len(known))
        return names[wide]

    # a transform's symbols are as many preceding bytes as 16 bits can name: fewer iterations for the same depth
    named = [last.astype(np.uint16)]
    while len(named) < min(6, depth) and (more := longer(named[-1])) is not None:
        named.append(more)
    order = np.concatenate(orders).astype(np.int32)
    rank = np.empty(len(raw), np.int32)
    rank[order] = np.arange(len(raw), dtype=np.int32)

    def step(k: int) -> tuple[np.ndarray, np.ndarray]:
        back = rank
        for _ in range(k):
            back = before(back)
        return named[k - 1][order], back[order]

    k = len(named)
    # only rotations that end up at a window that is over before its string are merged: that start `depth` bytes behind one
    own = np.repeat(np.arange(len(first)), size)
    windows = np.flatnonzero((np.arange(len(raw)) - first[own] >= depth)[order]).astype(np.int32)
    at, opened = merge(windows, [step(k)] * (depth // k) + ([step(depth % k)] if depth % k else []))
    out = least[own]
    if len(at):
        place = order[at]
        out[place] = np.minimum.reduceat(out[place], np.flatnonzero(opened))[np.cumsum(opened) - 1]
    return [out[a : a + n - depth] for a, n in zip(first.tolist(), size.tolist(), strict=True)]


ANCHORS = "part int, bucket int, codes binary, counts binary, several binary"
KINDS = "part int, bucket int, kinds binary"
STRETCHES = "part int, bucket int, names binary, codes binary, sizes binary, ids binary, bytes binary, hot binary"
ANSWERS = "part int, names binary, windows binary, owners binary, offsets binary, ids binary, hot binary"
RESULT = "doc_id long, n_bytes long, kept binary, spans array<struct<begin:int,end:int>>"


KIND_OF = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<struct<begin:int,end:int>>": pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))}


def _made(schema: str, rows: list[tuple]) -> pa.Table:
    target = pa.schema([(c, KIND_OF[k]) for c, k in (x.strip().split(" ", 1) for x in schema.split(", "))])
    columns = list(zip(*rows, strict=True)) or [()] * len(target)
    return pa.Table.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(columns, target, strict=True)], schema=target)


def remove_repeats(docs: DataFrame, n_parts: int | None = None) -> DataFrame:
    """docs(doc_id, text) as doc_id, n_bytes, kept (the bytes that stay) and spans (maximal removed byte runs, begin and end).

    Null texts count as empty, null ids as larger than all others; rows with one id never remove from each other. Texts
    shorter than the length stay whole. Matches never cross documents.
    """
    spark = docs.sparkSession
    if not n_parts:  # a part's texts are held by one task
        size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        n_parts = max(parts(spark), -(-size // PART_BYTES))
    n = n_parts
    keys = even_keys(spark, n)  # of parts and of buckets
    number = {k: i for i, k in enumerate(keys)}
    spread = even_keys(spark, n, SPREAD)  # of the buckets where stretches meet
    turn = F.pmod(F.xxhash64(F.lit(3), "doc_id", "text"), F.lit(n)).cast("int")
    part = F.element_at(F.array(*map(F.lit, keys)), turn + 1) if keys != list(range(n)) else turn
    dealt = docs.select("doc_id", "text").withColumn("part", part).repartition(n, "part")

    def part_of(t: pa.Table) -> Part:
        ids = np.array([_LAST if i is None else i for i in t.column("doc_id").to_pylist()], dtype=np.int64)
        return Part(ids, t.column("text").to_pylist())

    def send_anchors(t: pa.Table) -> pa.Table:
        p, part = part_of(t), t.column("part")[0].as_py()
        codes, _, count, several = _distinct(p.code, p.doc)
        rest = (codes // np.uint64(n)).astype(np.uint32)  # what the bucket number doesn't say, in 32 bits
        return _made(ANCHORS, [(part, keys[b], rest[k].tobytes(), np.minimum(count[k], 65535).astype(np.uint16).tobytes(), np.packbits(several[k]).tobytes()) for b, k in _grouped(_bucket(codes, n))])

    def shared_anchors(t: pa.Table) -> pa.Table:
        rest = [np.frombuffer(x, np.uint32) for x in t.column("codes").to_pylist()]
        size = np.array([len(x) for x in rest])
        several = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=k) for x, k in zip(t.column("several").to_pylist(), size.tolist(), strict=True)])
        counts = np.concatenate([np.frombuffer(x, np.uint16) for x in t.column("counts").to_pylist()]).astype(np.int64)
        codes, back, met = np.unique(np.concatenate(rest), return_inverse=True, return_counts=True)
        shared = (met > 1) | (np.bincount(back, weights=several, minlength=len(codes)) > 0)
        hot = np.bincount(back, weights=counts, minlength=len(codes)) > HOT
        kind = (shared.astype(np.uint8) + (shared & hot))[back]
        bound = np.cumsum(np.r_[0, size]).tolist()
        return _made(KINDS, [(p, b, kind[x:y].tobytes()) for p, b, x, y in zip(t.column("part").to_pylist(), t.column("bucket").to_pylist(), bound, bound[1:], strict=False)])

    def candidates(p: Part, kinds: dict[int, bytes]) -> tuple[np.ndarray, ...]:
        """Of the stretches that may repeat: code to meet by, document, begin, end, name; hot anchors as single windows, and their codes."""
        codes, back, _, _ = _distinct(p.code, p.doc)
        kind = np.zeros(len(codes), np.uint8)
        for b, k in _grouped(_bucket(codes, n)):
            kind[k] = np.frombuffer(kinds[b], np.uint8) if b in kinds else 0
        kind = kind[back]
        cold, hot = np.flatnonzero(kind == 1), np.flatnonzero(kind == 2)
        windows = p.end[hot] - p.begin[hot]
        single = np.repeat(p.begin[hot], windows) + (np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows))
        begin, end = np.r_[p.begin[cold], single], np.r_[p.end[cold], single + 1] + LENGTH - 1
        doc = np.r_[p.doc[cold], np.repeat(p.doc[hot], windows)]
        name = p.names(begin, end)
        code = np.r_[p.code[cold], name[len(cold) :]]
        return code, doc, begin, end, name, np.unique(p.code[hot])

    def send_stretches(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _made(STRETCHES, [])
        p, part = part_of(left), left.column("part")[0].as_py()
        code, doc, begin, end, name, hot = candidates(p, dict(zip(map(number.get, right.column("bucket").to_pylist()), right.column("kinds").to_pylist(), strict=True)))
        by = np.lexsort((p.ids[doc], name)) if len(name) else np.zeros(0, int)
        one = by[np.flatnonzero(np.r_[True, name[by][1:] != name[by][:-1]])] if len(by) else by
        rows = [(part, part, b"", b"", b"", b"", b"", hot.tobytes())] if len(hot) else []  # the part's own note
        for b, k in _grouped(_bucket(code[one], len(spread))):
            k = one[k]
            size = end[k] - begin[k]
            rest = (code[k] // np.uint64(len(spread))).astype(np.uint32)
            rows.append((part, spread[b], name[k].tobytes(), rest.tobytes(), size.astype(np.uint16).tobytes(), p.ids[doc[k]].tobytes(), _flat(p.flat, begin[k], size).tobytes(), b""))
        return _made(STRETCHES, rows)

    def match(t: pa.Table) -> pa.Table:
        strings: dict[bytes, int] = {}
        least: list[int] = []
        by: list[int] = []
        sent = []
        for codes, sizes, ids, data in zip(*(t.column(c).to_pylist() for c in ("codes", "sizes", "ids", "bytes")), strict=True):
            at, own = 0, []
            for c, k, i in zip(np.frombuffer(codes, np.uint32).tolist(), np.frombuffer(sizes, np.uint16).tolist(), np.frombuffer(ids, np.int64).tolist(), strict=True):
                j = strings.setdefault(data[at : at + k], len(strings))
                at += k
                if j == len(least):
                    least.append(i)
                    by.append(c)
                elif i < least[j]:
                    least[j] = i
                own.append(j)
            sent.append(own)
        lowest, texts = np.array(least, dtype=np.int64), list(strings)
        _, back, together = np.unique(np.array(by, dtype=np.int64), return_inverse=True, return_counts=True)
        met = np.flatnonzero(together[back] > 1) if len(by) else np.zeros(0, int)
        low: list = [None] * len(texts)
        for j, found in zip(met.tolist(), repeats([texts[j] for j in met.tolist()], lowest[met]), strict=True):
            low[j] = found
        for j in np.flatnonzero(together[back] == 1).tolist() if len(by) else []:
            low[j] = np.full(len(texts[j]) - LENGTH + 1, least[j])
        out = []
        for part, own, name, hot in zip(t.column("part").to_pylist(), sent, t.column("names").to_pylist(), t.column("hot").to_pylist(), strict=True):
            if not own:
                out.append((part, b"", b"", b"", b"", b"", hot))
                continue
            flat, windows = np.concatenate([low[j] for j in own]), np.array([len(low[j]) for j in own], dtype=np.int64)
            first = np.cumsum(windows) - windows
            cut = np.r_[True, flat[1:] != flat[:-1]]
            cut[first] = True
            at = np.flatnonzero(cut)
            owner = np.repeat(np.arange(len(own)), windows)[at]
            out.append((part, name, windows.astype(np.uint16).tobytes(), owner.astype(np.uint32).tobytes(), (at - first[owner]).astype(np.uint16).tobytes(), flat[at].tobytes(), hot))
        return _made(ANSWERS, out)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _made(RESULT, [])
        p = part_of(left)
        gone = np.zeros(len(p.flat) + 1, np.int32)
        column = lambda c: right.column(c).to_pylist()
        name = np.frombuffer(b"".join(column("names")), np.uint64)
        if len(name):
            windows = np.frombuffer(b"".join(column("windows")), np.uint16).astype(np.int64)
            shift = np.cumsum([0, *(len(x) // 8 for x in column("names"))]).tolist()
            owner = np.concatenate([np.frombuffer(x, np.uint32).astype(np.int64) + k for x, k in zip(column("owners"), shift, strict=False)])
            offset = np.frombuffer(b"".join(column("offsets")), np.uint16).astype(np.int64)
            ids = np.frombuffer(b"".join(column("ids")), np.int64)
            runs = np.searchsorted(owner, np.arange(len(name) + 1))  # runs of windows with one least id
            until = np.r_[offset[1:], 0]
            until[runs[1:] - 1] = windows
            by = np.argsort(name, kind="stable")
            for begin, end, doc in _asked(p, np.frombuffer(b"".join(column("hot")), np.uint64)):
                there = p.names(begin, end + LENGTH - 1)
                at = np.minimum(np.searchsorted(name, there, sorter=by), len(name) - 1)
                own = by[at]
                hit = np.flatnonzero((name[own] == there) & (windows[own] == end - begin))
                own = own[hit]
                k = runs[own + 1] - runs[own]
                which = np.repeat(hit, k)
                run = np.repeat(runs[own], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                earlier = ids[run] < p.ids[doc[which]]
                which, run = which[earlier], run[earlier]
                np.add.at(gone, begin[which] + offset[run], 1)
                np.add.at(gone, begin[which] + until[run] + LENGTH - 1, -1)
        removed = np.cumsum(gone[:-1], dtype=np.int32) > 0
        rows = []
        for i, a, raw in zip(p.ids.tolist(), p.base.tolist(), p.raw, strict=True):
            own = removed[a : a + len(raw)]
            edge = np.flatnonzero(np.diff(own.astype(np.int8), prepend=0, append=0)).tolist()
            kept = p.flat[a : a + len(raw)][~own].tobytes() if edge else raw
            rows.append((None if i == _LAST else i, len(raw), kept, [{"begin": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)]))
        return _made(RESULT, rows)

    kinds = dealt.groupBy("part").applyInArrow(send_anchors, ANCHORS).groupBy("bucket").applyInArrow(shared_anchors, KINDS)
    stretches = dealt.groupBy("part").cogroup(kinds.groupBy("part")).applyInArrow(send_stretches, STRETCHES)
    answers = stretches.groupBy("bucket").applyInArrow(match, ANSWERS)
    return dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(finish, RESULT)


def _asked(p: Part, hot: np.ndarray):
    """(begin, end, document) of the part's stretches, then of the single windows of those with a hot anchor."""
    yield p.begin, p.end, p.doc
    rest = np.flatnonzero(np.isin(p.code, hot)) if len(hot) else np.zeros(0, int)
    for some in np.array_split(rest, -(-len(rest) // 50_000)) if len(rest) else []:
        size = p.end[some] - p.begin[some]
        begin = np.repeat(p.begin[some], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        yield begin, begin + 1, np.repeat(p.doc[some], size)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (see remove_repeats for nulls, short texts, ties and repeated rows)."""
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
