"""Media columns in ISO base media containers.

`mux` stores a byte string as one uncompressed grey video track: 576 bytes a sample (24 x 24 pixels of 8 bits), a
sync sample every `KEY_EVERY`. `probe` walks the nested boxes of any such container, decodes its sample tables, and the
runs of its fragments if it has any, and reports codec, duration and the byte range of every keyframe; it never decodes a sample. `samples` gives the stored
bytes back from the tables' offsets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillstack.llm.common import arrow_map, read, table

SIDE, UNIT, TIMESCALE, KEY_EVERY, CODEC = 24, 576, 25, 12, b"raw "
#: Boxes that hold boxes, with the bytes of their own that come first.
NESTING = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"edts": 0, b"dinf": 0, b"moof": 0, b"traf": 0, b"mvex": 0, b"udta": 0, b"stsd": 8, b"meta": 4}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def _full(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *content)


def pad(raw: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of the unit."""
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def mux(payload: bytes) -> bytes:
    """A container with the payload as its samples; a pure function of the payload, whose length is a multiple of 576."""
    n = len(payload) // UNIT
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = _box(CODEC, bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    head = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def movie(at: int) -> bytes:
        offset = _full(b"stco", struct.pack(">II", 1, at)) if at < 1 << 32 else _full(b"co64", struct.pack(">IQ", 1, at))
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, 1)),
            _full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            _full(b"stsc", struct.pack(">IIII", 1, 1, n, 1)),
            _full(b"stsz", struct.pack(">II", UNIT, n)),
            offset,
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"bytes\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhhH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=7), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2)), track)

    wide = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(movie(0))
    return head + movie(len(head) + size + wide) + _box(b"mdat", payload)


def boxes(data: bytes, at: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, first byte of the content, end) of each box, parents first. A box that overruns its parent raises ValueError."""
    end = len(data) if end is None else end
    while at < end:
        if end - at < 8:
            raise ValueError(f"{end - at} stray bytes at {at}")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if end - at < 16:
                raise ValueError(f"a cut large size at {at}")
            size, body = struct.unpack_from(">Q", data, body)[0], at + 16
        elif size == 0:
            size = end - at
        if kind == b"uuid":
            body += 16
        if at + size > end or size < body - at:
            raise ValueError(f"box {kind!r} at {at} has size {size}; {end - at} bytes are left")
        yield (*path, kind), body, at + size
        if kind in NESTING:
            yield from boxes(data, body + NESTING[kind], at + size, (*path, kind))
        at += size


def _table(data: bytes, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, dtype=kind, count=n * columns, offset=at + 8).astype(np.int64).reshape(n, columns) if columns > 1 else np.frombuffer(data, dtype=kind, count=n, offset=at + 8).astype(np.int64)


class Fragments:
    """The samples that movie fragments add to tracks, from their headers, runs and the tracks' defaults."""

    def __init__(self, data: bytes):
        self.data, self.defaults, self.runs = data, {}, {}
        self.moof, self.base, self.track, self.own, self.next = 0, 0, 0, (0, 0, 0), None

    def meet(self, kind: bytes, at: int, end: int) -> None:
        """One box, in order: trex, moof, tfhd, trun."""
        data = self.data
        if kind == b"trex":
            track, _, duration, size, flags = struct.unpack_from(">IIIII", data, at + 4)
            self.defaults[track] = (duration, size, flags)
        elif kind == b"moof":
            # data offsets count from the first byte of the box
            self.moof = at - (16 if data[at - 16 : at - 12] == b"\0\0\0\1" and data[at - 12 : at - 8] == b"moof" else 8)
            self.next = None
        elif kind == b"tfhd":
            flags, self.track = struct.unpack_from(">II", data, at)
            at += 8
            # without a base of its own a later track fragment follows the data of the one before
            self.base = self.moof if flags & 0x20000 or self.next is None else self.next
            self.next = self.base
            if flags & 0x1:
                self.base = self.next = struct.unpack_from(">Q", data, at)[0]
                at += 8
            at += 4 * bool(flags & 0x2)
            own = list(self.defaults.get(self.track, (0, 0, 0)))
            for i, bit in enumerate((0x8, 0x10, 0x20)):
                if flags & bit:
                    own[i] = struct.unpack_from(">I", data, at)[0]
                    at += 4
            self.own = tuple(own)
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", data, at)
            flags, at = flags & 0xFFFFFF, at + 8
            start = self.next
            if flags & 0x1:
                start = self.base + struct.unpack_from(">i", data, at)[0]
                at += 4
            first = None
            if flags & 0x4:
                first = struct.unpack_from(">I", data, at)[0]
                at += 4
            columns = [i for i, bit in enumerate((0x100, 0x200, 0x400, 0x800)) if flags & bit]
            if at + 4 * n * len(columns) > end:
                raise ValueError("a run is cut")
            cells = np.frombuffer(data, ">u4", n * len(columns), at).reshape(n, len(columns)).astype(np.int64)
            duration, size, kinds = (cells[:, columns.index(i)] if i in columns else np.full(n, self.own[i], dtype=np.int64) for i in range(3))
            if first is not None and n:
                kinds = np.r_[first, kinds[1:]]
            self.runs.setdefault(self.track, []).append((start + np.cumsum(size) - size, size, (kinds & 0x10000) == 0, duration))
            self.next = start + int(size.sum())

    def of(self, track: int) -> list[tuple[np.ndarray, ...]]:
        return self.runs.get(track, [])


def tracks(data: bytes) -> list[dict]:
    """Of each track: codec, timescale, duration, width, height (of pictures alone), and arrays of sample offsets, sizes and sync samples."""
    out: list[dict] = []
    fragments = Fragments(data)
    for path, at, end in boxes(data):
        kind = path[-1]
        if kind == b"trak":
            out.append({"id": 0, "handler": b"", "codec": "", "timescale": 0, "duration": 0, "width": 0, "height": 0, "sync": None})
        if path[0] == b"moof" or kind == b"trex":
            fragments.meet(kind, at, end)
        if not out or b"trak" not in path:
            continue
        t = out[-1]
        if kind == b"tkhd":
            t["id"] = struct.unpack_from(">I", data, at + (20 if data[at] == 1 else 12))[0]
        elif kind == b"hdlr" and path[-2] == b"mdia":
            t["handler"] = data[at + 8 : at + 12]
        elif kind == b"mdhd":
            long = data[at] == 1
            t["timescale"], t["duration"] = struct.unpack_from(">IQ" if long else ">II", data, at + (20 if long else 12))
        elif len(path) > 1 and path[-2] == b"stsd" and not t["codec"]:
            t["codec"] = kind.decode("latin-1")
            if t["handler"] == b"vide" and end - at >= 28:
                t["width"], t["height"] = struct.unpack_from(">HH", data, at + 24)
        elif kind == b"stsz":
            fixed, n = struct.unpack_from(">II", data, at + 4)
            t["sizes"] = np.full(n, fixed, dtype=np.int64) if fixed else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
        elif kind == b"stz2":
            bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
            raw = np.frombuffer(data, np.uint8 if bits <= 8 else ">u2", -(-n * bits // 8) if bits <= 8 else n, at + 12)
            t["sizes"] = (np.stack([raw >> 4, raw & 15], 1).ravel()[:n] if bits == 4 else raw).astype(np.int64)
        elif kind == b"stsc":
            t["runs"] = _table(data, at, 3)
        elif kind == b"stco":
            t["chunks"] = _table(data, at, 1)
        elif kind == b"co64":
            t["chunks"] = _table(data, at, 1, ">u8")
        elif kind == b"stss":
            t["sync"] = _table(data, at, 1) - 1
    for t in out:
        sizes, chunks, runs = t.pop("sizes", np.zeros(0, np.int64)), t.pop("chunks", np.zeros(0, np.int64)), t.pop("runs", np.zeros((0, 3), np.int64))
        counts = np.zeros(len(chunks), dtype=np.int64)
        for i, (first, each, _) in enumerate(runs):
            counts[first - 1 : runs[i + 1][0] - 1 if i + 1 < len(runs) else None] = each
        if counts.sum() < len(sizes):
            raise ValueError("the chunk tables hold fewer samples than the size table")
        chunk = np.repeat(np.arange(len(chunks)), counts)[: len(sizes)]
        before = np.cumsum(sizes) - sizes
        first = np.r_[True, chunk[1:] != chunk[:-1]] if len(chunk) else np.zeros(0, bool)
        base = before[first]
        t["at"] = chunks[chunk] + before - base[np.cumsum(first) - 1] if len(chunk) else before
        t["sizes"] = sizes
        t["sync"] = np.arange(len(sizes)) if t["sync"] is None else t["sync"]
        if more := fragments.of(t.pop("id")):
            places, lengths, syncs, lasting = (np.concatenate(x) for x in zip(*more, strict=True))
            t["sync"] = np.r_[t["sync"], len(sizes) + np.flatnonzero(syncs)]
            t["at"], t["sizes"] = np.r_[t["at"], places], np.r_[sizes, lengths]
            t["duration"] = t["duration"] or int(lasting.sum())
            sizes = t["sizes"]
        if len(sizes) and int((t["at"] + sizes).max()) > len(data):
            raise ValueError("a sample lies beyond the end of the data")
    return out


def samples(data: bytes) -> bytes:
    """The first track's stored bytes, in sample order; neighbouring samples are read in one piece."""
    t = tracks(data)[0]
    at, end = t["at"], t["at"] + t["sizes"]
    cut = np.flatnonzero(np.r_[True, at[1:] != end[:-1]]) if len(at) else np.zeros(0, int)
    last = np.r_[cut[1:], len(at)] - 1 if len(at) else cut
    return b"".join(data[a:b] for a, b in zip(at[cut].tolist(), end[last].tolist(), strict=True))


def feature(data: bytes) -> str:
    """codec:width x height:timescale:duration:samples:keyframes:crc32 of the keyframe byte ranges, for each track."""
    said = []
    for t in tracks(data):
        ranges = np.stack([t["at"][t["sync"]], (t["at"] + t["sizes"])[t["sync"]]], 1).astype("<i8")
        said.append(f"{t['codec'].strip()}:{t['width']}x{t['height']}:{t['timescale']}:{t['duration']}:{len(t['sizes'])}:{len(ranges)}:{zlib.crc32(ranges.tobytes()):08x}")
    return "|".join(said)


PROBE = "codec string, timescale long, duration long, width int, height int, n_samples long, keyframes array<struct<begin:long,end:long>>, error string"


def probe(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """key and the first track's metadata. Null, cut or malformed media give nulls and an error text, never a failed task."""

    def rows(batch) -> dict:
        out = {c: [] for c in ("codec", "timescale", "duration", "width", "height", "n_samples", "keyframes", "error")}
        for cell in batch.column(1):
            got: dict = {}
            try:
                if not cell.is_valid:
                    raise ValueError("no media")
                found = tracks(cell.as_py())
                if not found:
                    raise ValueError("no track")
                t = found[0]
                got = {k: t[k] for k in ("codec", "timescale", "duration", "width", "height")} | {"n_samples": len(t["sizes"])}
                at = t["at"][t["sync"]]
                got["keyframes"] = [{"begin": a, "end": b} for a, b in zip(at.tolist(), (at + t["sizes"][t["sync"]]).tolist(), strict=True)]
            except (ValueError, struct.error, IndexError) as e:
                got = {"error": str(e) or type(e).__name__}
            for c in out:
                out[c].append(got.get(c))
        return out | {"key": batch.column(0)}

    kind = dict(df.dtypes)[key]
    return arrow_map(df.select(key, media), rows, f"key {kind}, {PROBE}").withColumnRenamed("key", key)


def store(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) as a written table (doc_id, n_bytes, media). A null text counts as empty, one sample of padding."""

    def rows(batch) -> dict:
        raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), "n_bytes": [len(r) for r in raw], "media": [mux(pad(r)) for r in raw]}

    return table(arrow_map(docs.select("doc_id", "text"), rows, "doc_id long, n_bytes long, media binary"), "media", compression="zstd")


def digest(stored: DataFrame) -> DataFrame:
    """Payload and container digests and the feature of each stored row, all from the bytes as read back."""

    def rows(batch) -> dict:
        out: dict = {c: [] for c in ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "keyframes")}
        for cell in batch.column("media"):
            data = cell.as_py()
            payload, t = samples(data), tracks(data)[0]
            at = t["at"][t["sync"]]
            out["keyframes"].append([{"begin": a, "end": b} for a, b in zip(at.tolist(), (at + t["sizes"][t["sync"]]).tolist(), strict=True)])
            out["payload_bytes"].append(len(payload))
            out["payload_sha256"].append(hashlib.sha256(payload).hexdigest())
            out["tail_crc32"].append(zlib.crc32(payload[-32:]))
            out["media_bytes"].append(len(data))
            out["media_sha256"].append(hashlib.sha256(data).hexdigest())
            out["feature"].append(feature(data))
        return out | {"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")}

    return arrow_map(stored, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes array<struct<begin:long,end:long>>")


def op6_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: the digests and feature of its stored bytes and its keyframes' byte ranges.

    A null or empty text is one sample of padding. Equal texts have equal values; null ids stay null; texts of any length are whole.
    """
    return digest(store(read(spark, sf_dir, "documents")))
