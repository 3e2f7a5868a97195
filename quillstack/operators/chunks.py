"""Chunking and the resumable vector index: word and token windows, shards, consolidation, integrity."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstack.functions.hashing import fingerprint
from quillstack.functions.text import chunk_words, clean_html, document_text, words
from quillstack.session import checkpointed
from quillstack.sources.storage import Folder

#: Special tokens of tokenizers that don't say how many they add, and tokens left free for what decoding changes.
SPECIAL_TOKENS, MARGIN = 2, 4


class Tokenizer(Protocol):
    def encode(self, text: str) -> list[int]: ...

    def decode(self, ids: list[int]) -> str: ...


class IndexIntegrityError(RuntimeError):
    pass


def documents_to_chunks(df: DataFrame, doc_id: str, parts: list[str], size: int = 100, overlap: int = 20, html: bool = True) -> DataFrame:
    """(doc_id, chunk_index, text) of windows of words; documents without text give no rows."""
    cleaned = [clean_html(p) if html else F.coalesce(F.col(p), F.lit("")) for p in parts]
    chunks = chunk_words(words(document_text(*cleaned)), size, overlap)
    return df.select(F.col(doc_id).alias("doc_id"), F.posexplode(chunks).alias("chunk_index", "text"))


def token_windows(text: str, tokenizer: Tokenizer, most: int = 128, overlap: int = 16) -> list[str]:
    """Windows of token ids as text; each fits `most` tokens when encoded again, with the special tokens that the tokenizer adds; none is empty."""
    if most < 1 or not 0 <= overlap < most:
        raise ValueError("most must be positive and 0 <= overlap < most")
    added = getattr(tokenizer, "num_special_tokens_to_add", None)
    special = SPECIAL_TOKENS if added is None else added(False)
    budget = most - special - MARGIN
    if budget <= overlap:
        raise ValueError("the window leaves no room beside the overlap")
    ids = tokenizer.encode(text)

    def fitted(part: list[int]) -> str:
        while part:
            out = tokenizer.decode(part)
            if len(tokenizer.encode(out)) + special <= most:
                return out
            part = part[:-1]
        return ""

    starts = [0] if len(ids) <= budget else range(0, len(ids) - overlap, budget - overlap)
    return [w for s in starts if (w := fitted(ids[s : s + budget]).strip())]


def documents_to_token_chunks(df: DataFrame, doc_id: str, text: str, make_tokenizer: Callable[[], Tokenizer], most: int = 128, overlap: int = 16) -> DataFrame:
    """As documents_to_chunks, with any tokenizer, made once in each task."""

    def run(batches):
        tokenizer = make_tokenizer()
        for batch in batches:
            rows = [(d, i, w) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, w in enumerate(token_windows(t or "", tokenizer, most, overlap) if t else [])]
            names, index, out = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(names), type=batch.column(0).type), pa.array(list(index), pa.int32()), pa.array(list(out), pa.string())], names=["doc_id", "chunk_index", "text"])

    return df.select(doc_id, text).mapInArrow(run, f"doc_id {dict(df.dtypes)[doc_id]}, chunk_index int, text string")


def positioned(chunks: DataFrame, order: list[str | Column], name: str = "pos", start: int = 0) -> DataFrame:
    """chunks with `pos` (or another name), dense from 0 (or another start) in the order, without a global sort in one task: partitions by range, counts, offsets."""
    spark = chunks.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # materialised once: the partition numbers must be those that the counts saw
    ranged = checkpointed(chunks.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n")).orderBy("__part").collect()  # a row for each partition
    offsets, total = [], 0
    for r in counts:
        offsets.append((r["__part"], total))
        total += r["n"]
    at = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.join(F.broadcast(spark.createDataFrame(offsets, "__part int, __base long")), "__part").withColumn(name, F.col("__base") + at + start).drop("__part", "__base")


def first_documents(chunks: DataFrame, n: int) -> DataFrame:
    """The chunks of the first n documents by id."""
    return chunks.join(chunks.select("doc_id").distinct().orderBy("doc_id").limit(n), "doc_id", "left_semi")


def shard_of(pos: Column | str, size: int) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / size).cast("long")


def shard_bounds(df: DataFrame, pos: str, size: int) -> DataFrame:
    """(shard_id, first, last, n) of contiguous shards."""
    return df.groupBy(shard_of(pos, size).alias("shard_id")).agg(F.min(pos).alias("first_pos"), F.max(pos).alias("last_pos"), F.count("*").alias("n"))


def build_index(spark: SparkSession, chunks: DataFrame, encode: Callable[[Column], Column], folder: str | Path, dim: int, settings: dict, shard_size: int = 2000, limit_docs: int | None = None, overwrite: bool = False) -> dict:
    """A resumable build: chunks with positions once, then only the shards that aren't complete, then the account.

    settings name the model and the chunking; a folder begun with others is refused unless overwrite is set.
    """
    own = Folder(spark, folder)
    state = settings | {"chunks_fingerprint": fingerprint(chunks.select("doc_id", "chunk_index", "text")), "dim": dim, "shard_size": shard_size, "limit_docs": limit_docs}
    known = own.read_json("state.json")
    if known and known != state and not overwrite:
        raise IndexIntegrityError(f"begun with other settings: {sorted(k for k in state if known.get(k) != state[k])}")
    if overwrite or not known:
        for name in ("chunks", "vectors", "meta.json"):
            own.delete(name)
        rows = chunks if limit_docs is None else first_documents(chunks, limit_docs)
        positioned(rows, ["doc_id", "chunk_index"]).withColumn("shard_id", shard_of("pos", shard_size)).write.mode("overwrite").parquet(own.at("chunks"))
        own.write_json("state.json", state)
    elif (meta := own.read_json("meta.json")) is not None:
        return meta
    placed = spark.read.parquet(own.at("chunks"))
    todo = placed
    if own.exists("vectors"):
        have = spark.read.parquet(own.at("vectors")).where(F.size("embedding") == dim).groupBy("shard_id").agg(F.count("*").alias("have"))
        whole = placed.groupBy("shard_id").agg(F.count("*").alias("n")).join(have, "shard_id").where("have = n").select("shard_id")
        todo = placed.join(whole, "shard_id", "left_anti")
    done = todo.withColumn("embedding", encode(F.col("text"))).repartition("shard_id")
    done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard_id").parquet(own.at("vectors"))
    return consolidate(spark, folder)


def consolidate(spark: SparkSession, folder: str | Path) -> dict:
    """The account of a complete build; refuses an incomplete one."""
    own = Folder(spark, folder)
    state = own.read_json("state.json")
    placed, vectors = spark.read.parquet(own.at("chunks")), spark.read.parquet(own.at("vectors"))
    wrong = placed.select("pos").join(vectors.where(F.size("embedding") == state["dim"]).select("pos"), "pos", "left_anti")
    if not wrong.isEmpty():
        raise IndexIntegrityError("some shards are incomplete")
    told = placed.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("shard_id").alias("n_shards")).first().asDict()
    meta = state | told | {"is_partial_index": state["limit_docs"] is not None}
    own.write_json("meta.json", meta)
    return meta


def load_index(spark: SparkSession, folder: str | Path) -> tuple[DataFrame, dict]:
    """(chunks with embeddings, account) of a complete, whole index."""
    own = Folder(spark, folder)
    meta = own.read_json("meta.json")
    if meta is None:
        raise IndexIntegrityError("no complete index is here")
    if meta["is_partial_index"]:
        raise IndexIntegrityError("the index covers part of the documents only")
    vectors = spark.read.parquet(own.at("vectors"))
    if lacking := {"doc_id", "chunk_index", "text", "embedding"} - set(vectors.columns):
        raise IndexIntegrityError(f"columns are missing: {sorted(lacking)}")
    told = vectors.agg(F.count("*").alias("n"), F.count_if(F.size("embedding") != meta["dim"]).alias("wrong")).first()
    if told["n"] != meta["n_chunks"] or told["wrong"]:
        raise IndexIntegrityError(f"{told['n']} chunks of {meta['n_chunks']}, {told['wrong']} of another size")
    return vectors, meta

