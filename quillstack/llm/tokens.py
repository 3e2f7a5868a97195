"""Token-ID output in directly addressable codes (DACs).

An id is cut into chunks of `chunk_bits`, lowest first. Level k holds chunk k of every id that has one, and a
bitmap says for each chunk whether its id goes on at level k + 1. A rank directory (set bits before each block of
512) turns that bitmap into an index, so any id is read with one probe a level and no block is decoded.

A token table is a folder of Parquet rows (shard, seq, n_docs, n_tokens, payload); each payload is one
self-contained DAC file. Spark's committer publishes them, so lost executors leave no half-written file, and
every reader that Spark has can reach them.
"""

from __future__ import annotations

import struct
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import count, islice
from string import punctuation

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.pandas.types import to_arrow_schema

from quillstack.llm.common import parts, read, release, table, to_batch

MAGIC = b"QDAC"
RANK_BLOCK = 512
END_ID = 2
HEAD = struct.Struct("<4sBBHIQQ")
FILE_SCHEMA = "shard int, seq int, n_docs int, n_tokens long, payload binary"
DOC_SCHEMA = "shard int, doc_id long, begin long, n_tokens long, ids_crc32 long"


def dac_encode(ids: np.ndarray, starts: np.ndarray, doc_ids: list[int | None], before: int = 0, chunk_bits: int = 8) -> bytes:
    """One DAC file. ids: all tokens; starts: first token of each document and the total; before: tokens of the shard that precede."""
    width = np.uint8 if chunk_bits <= 8 else np.uint16
    levels, rest = [], np.asarray(ids, dtype=np.uint32)
    while True:
        more = (rest >> np.uint32(chunk_bits)) > 0
        chunks = (rest & np.uint32((1 << chunk_bits) - 1)).astype(width)
        bits = np.packbits(more, bitorder="little")
        ranks = np.concatenate([[0], np.cumsum(np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BLOCK)))]).astype(np.uint32) if len(more) else np.zeros(1, np.uint32)
        levels.append(struct.pack("<QQ", len(chunks), len(bits)) + chunks.tobytes() + bits.tobytes() + ranks.tobytes())
        if not more.any():
            break
        rest = rest[more] >> np.uint32(chunk_bits)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    names = np.array([d if d is not None else 0 for d in doc_ids], dtype=np.int64)
    head = HEAD.pack(MAGIC, 1, chunk_bits, len(levels), len(doc_ids), len(ids), before)
    return head + names.tobytes() + known.tobytes() + np.asarray(starts, dtype=np.uint64).tobytes() + b"".join(levels)


class DacFile:
    """A view of one DAC file: documents, single tokens by position, and ranges."""

    def __init__(self, payload: bytes):
        magic, version, self.chunk_bits, n_levels, n_docs, self.n_tokens, self.before = HEAD.unpack_from(payload)
        if magic != MAGIC or version != 1:
            raise ValueError("not a DAC file of version 1")
        at = HEAD.size

        def take(kind: type, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, dtype=kind, count=n, offset=at)
            at += out.nbytes
            return out

        names, known = take(np.int64, n_docs), take(np.uint8, n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known, strict=True)]
        self.starts = take(np.uint64, n_docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n, n_bits = struct.unpack_from("<QQ", payload, at)
            at += 16
            chunks = take(np.uint8 if self.chunk_bits <= 8 else np.uint16, n)
            self.levels.append((chunks, take(np.uint8, n_bits), take(np.uint32, -(-n // RANK_BLOCK) + 1)))

    def __getitem__(self, i: int) -> int:
        """The token at a position: a bitmap probe and a rank for each level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            block = i // RANK_BLOCK
            own = np.unpackbits(bits[block * RANK_BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(ranks[block]) + int(own[: i - block * RANK_BLOCK].sum())
            shift += self.chunk_bits
        return value

    def all(self) -> np.ndarray:
        """Every token, level by level."""
        out = np.zeros(self.n_tokens, dtype=np.uint32)
        own, shift = np.arange(self.n_tokens), 0
        for chunks, bits, _ in self.levels:
            out[own] |= chunks.astype(np.uint32) << np.uint32(shift)
            own = own[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
            shift += self.chunk_bits
        return out


def _units(known: Iterable[str | tuple[str]] = ()) -> dict:
    """Gives each new key the next number, after those of the known ones."""
    found = {k: i for i, k in enumerate(known)}
    return defaultdict(count(len(found)).__next__, found)


def _runs(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat's runs of so many entries from each begin, in a row."""
    ends = np.cumsum(size)
    return flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class UnitEncoder:
    """Whole texts to ids through the tokenizers library, each distinct unit encoded once.

    The vocabulary's splitter always cuts before a single space or line end that stands between two characters that are no
    white space, so the ids of a text are those of its units in order. Other white space is not cut at. When the memo has
    max_units entries, the half that was met most stays; that changes no id.
    """

    def __init__(self, path: str, max_units: int = 400_000):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.lib, self.max_units = Tokenizer.from_file(path), max_units
        # only for a byte-level BPE without other steps are words of letters the library's model alone
        plain = isinstance(self.lib.model, models.BPE) and isinstance(self.lib.pre_tokenizer, pre_tokenizers.ByteLevel) and self.lib.pre_tokenizer.use_regex and self.lib.normalizer is None
        split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the library's own letter for each byte that can stand in UTF-8
        shown = {i: split.pre_tokenize_str(chr(i))[0][0] for i in range(128)}
        for i in range(128, 0x800):
            shown |= dict(zip(chr(i).encode(), split.pre_tokenize_str(chr(i))[0][0], strict=True))
        for c in ("\u0800", "\u1000", "\u4000", "\u8000", "\uac00", "\uf000", "\U00010000", "\U00040000", "\U00080000", "\U000c0000", "\U00100000", *map(chr, range(0x0FC0, 0xD7C0, 0x1000))):
            shown |= dict(zip(c.encode(), split.pre_tokenize_str(c)[0][0], strict=True))
        self.shown = shown
        vocab = self.lib.get_vocab(with_added_tokens=False)
        self.joint = Tokenizer(self.lib.model) if plain and self._apart(vocab) else None
        self.leads = np.zeros(max(vocab.values(), default=0) + 1, bool)
        self.leads[[i for t, i in vocab.items() if t[:1] in (shown[32], shown[10])]] = True
        self.cut = re.compile(r"(?<=\S) (?=\S)")
        self.clear()

    def _apart(self, vocab: dict[str, int]) -> bool:
        """Whether no token can reach over the start of a word where words of letters, led by a space or line end each, stand in a row.
        Then no merge does, and the model gives the row the ids of its words."""
        model, byte = self.lib.model, {c: i for i, c in self.shown.items()}
        if model.dropout or model.unk_token or model.continuing_subword_prefix or model.end_of_word_suffix or model.byte_fallback or model.ignore_merges:
            return False
        for token in vocab:
            if self.shown[32] in token[1:] or self.shown[10] in token[1:] or token[:1] == self.shown[10] and len(token) > 1:
                try:
                    text = bytes(byte[c] for c in token).decode()
                except (KeyError, UnicodeDecodeError):
                    return False
                if all(c.isalpha() or c in " \n" for c in text) and not any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
                    return False
        return all(self.shown[i] in vocab for i in (32, 10))

    def clear(self) -> None:
        self.units, self.flat, self.sizes = _units(), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self.uses = np.zeros(0, np.int64)
        self.known = 0

    def _forget(self) -> None:
        """Keep the units that were met most, half of the memo at most and none that was met once."""
        flat, sizes = np.concatenate(self.flat), np.concatenate(self.sizes)
        keep = np.sort(np.argsort(-self.uses, kind="stable")[: self.max_units // 2])
        keep = keep[self.uses[keep] > 1]
        names, begin = list(self.units), np.cumsum(sizes) - sizes
        self.units = _units(names[i] for i in keep.tolist())
        self.flat, self.sizes = [_runs(flat, begin[keep], sizes[keep])], [sizes[keep]]
        self.uses, self.known = self.uses[keep] // 2, len(keep)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if len(self.units) > self.max_units:
            self._forget()
        index, counts = [], np.zeros(len(texts), dtype=np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            # without white space but spaces and line ends, and none beside another, every one is such a cut
            plain = text.replace("\n", "").isprintable() and not (text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text)
            pieces = text.replace("\n", " \n").split(" ") if plain else self.cut.split(text)
            if len(pieces) > 1:
                # a text's first unit has no space before it; a tuple keeps the two kinds of key apart, whatever characters they hold
                pieces[0] = (pieces[0],)
                got = np.fromiter(map(self.units.__getitem__, pieces), dtype=np.int64, count=len(pieces))
            else:
                got = np.array([self.units[pieces[0],]], dtype=np.int64)
            index.append(got)
            counts[i] = len(got)
        if len(self.units) > self.known:
            fresh = list(islice(self.units, self.known, None))
            # only a unit that a line end leads has no space before it
            flat, sizes = self._units_to_ids([k[0] if isinstance(k, tuple) else k if k[0] == "\n" else " " + k for k in fresh])
            self.sizes.append(sizes)
            self.flat.append(flat)
            self.known = len(self.units)
        flat, sizes = np.concatenate(self.flat), np.concatenate(self.sizes)
        self.flat, self.sizes = [flat], [sizes]
        at = np.concatenate(index) if index else np.zeros(0, np.int64)
        uses = np.bincount(at, minlength=self.known)
        uses[: len(self.uses)] += self.uses
        self.uses = uses
        n = sizes[at]
        total = np.concatenate([[0], np.cumsum(n)])
        bound = np.concatenate([[0], np.cumsum(counts)])
        return _runs(flat, (np.cumsum(sizes) - sizes)[at], n), total[bound[1:]] - total[bound[:-1]]

    def _units_to_ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all units, number of ids of each). Words of letters are the model's, many in a row; ASCII signs after a word are
        encoded by themselves, as the splitter has them, and other units whole."""
        lengths = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        char = np.frombuffer("".join(units).encode("utf-32-le"), dtype=np.uint32)
        start, kind = np.cumsum(lengths) - lengths, _kinds()[char]
        # one past the last character that is no sign, and whether all between the first and that one are letters
        end = np.maximum.reduceat(np.where(kind == 2, 0, np.arange(1, len(char) + 1)), start)
        letters = np.add.reduceat(kind == 1, start, dtype=np.int64) - (kind[start] == 1)
        is_word = ((char[start] == 32) | (char[start] == 10)) & (end > start + 1) & (letters == end - start - 1) if self.joint else np.zeros(len(units), bool)
        tails, whole = _units([""]), _units()
        tail = np.zeros(len(units), dtype=np.int64)
        for i in np.flatnonzero(is_word & (end < start + lengths)).tolist():
            tail[i] = tails[units[i][end[i] - start[i] :]]
        other = np.fromiter((whole[units[i]] for i in np.flatnonzero(~is_word).tolist()), dtype=np.int64)
        flat, sizes = [], []
        words = np.flatnonzero(is_word)
        for k in range(0, len(words), 64):
            own = words[k : k + 64]
            row = _runs(char, start[own], end[own] - start[own]).tobytes().decode("utf-32-le")
            row = row.encode().decode("latin-1").translate(self.shown)
            ids = np.array(self.joint.encode_batch_fast([row], add_special_tokens=False)[0].ids, dtype=np.uint32)
            flat.append(ids)
            sizes.append(np.diff(np.flatnonzero(self.leads[ids]), append=len(ids)))
        for few in (tails, whole):
            ids = [x.ids for x in self.lib.encode_batch_fast(list(few), add_special_tokens=False)]
            flat.append(np.fromiter((x for one in ids for x in one), dtype=np.uint32))
            sizes.append(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
        flat, sizes = np.concatenate(flat), np.concatenate(sizes)
        parts = np.c_[np.cumsum(is_word) - 1, len(words) + tail]
        parts[~is_word, 0] = len(words) + len(tails) + other
        n = sizes[parts]
        return _runs(flat, (np.cumsum(sizes) - sizes)[parts].ravel(), n.ravel()), n.sum(axis=1)


@cache
def _kinds() -> np.ndarray:
    """Of each character 1 for a letter, 2 for an ASCII sign, else 0."""
    out = np.fromiter(map(str.isalpha, map(chr, range(0x110000))), dtype=np.uint8, count=0x110000)
    out[list(punctuation.encode())] = 2
    return out


_encoders: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = UnitEncoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, tokens_per_file: int = 1_000_000) -> DataFrame:
    """Encode docs(doc_id, text) in ascending doc_id order (null last; equal ids by text) and write DAC files.

    Returns the table read back, one row a file. A null or empty text gives the end id alone. Range partitions
    make the shards, so no task sees more than its range; a file closes after tokens_per_file ids at a text's end.
    """
    spark, path = docs.sparkSession, tokenizer or default_tokenizer()
    order = [F.col("doc_id").asc_nulls_last()]
    ranged = docs.select("doc_id", "text").repartitionByRange(parts(spark), *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    target = to_arrow_schema(StructType.fromDDL(FILE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        shard, seq, before = TaskContext.get().partitionId(), 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, before, held, size
            ids, counts, names = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), sum((h[2] for h in held), [])
            starts = np.concatenate([[0], np.cumsum(counts)])
            payload = dac_encode(ids, starts, names, before)
            out = to_batch({"shard": [shard], "seq": [seq], "n_docs": [len(names)], "n_tokens": [len(ids)], "payload": [payload]}, target)
            seq, before, held, size = seq + 1, before + len(ids), [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, counts = enc.encode([t or "" for t in part.column("text").to_pylist()])
                ids = np.insert(ids, np.cumsum(counts), np.uint32(end_id)).astype(np.uint32)
                held.append((ids, counts + 1, part.column("doc_id").to_pylist()))
                size += len(ids)
                if size >= tokens_per_file:
                    yield flush()
        if held:
            yield flush()
        release()

    return table(ranged.mapInArrow(run, FILE_SCHEMA), "tokens", compression="zstd")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row a document, decoded from the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""
    spark = files.sparkSession
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect()  # a row for each range partition
    bases, base = [], 0
    for r in totals:
        bases.append((r["shard"], base))
        base += r["n"]
    target = to_arrow_schema(StructType.fromDDL(DOC_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                f = DacFile(payload.as_py())
                raw = f.all().astype("<u4").tobytes()
                ends = f.starts.tolist()
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
                yield to_batch({"shard": [shard] * len(crc), "doc_id": f.doc_ids, "begin": f.starts[:-1] + f.before, "n_tokens": np.diff(f.starts), "ids_crc32": crc}, target)
        release()

    docs = files.select("shard", "payload").mapInArrow(run, DOC_SCHEMA)
    offsets = spark.createDataFrame(bases, "shard int, base long")
    return docs.join(F.broadcast(offsets), "shard").select("doc_id", (F.col("base") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_dac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document, read back from the files: doc_id, start, n_tokens (with the end id), ids_crc32.

    A null or empty text has the end id alone. Null ids come last; rows with equal ids are ordered by text, so that equal
    rows are alike but for their start. Texts of any length are whole. An empty table gives no rows.
    """
    return read_tokens(write_tokens(read(spark, sf_dir, "documents")))
