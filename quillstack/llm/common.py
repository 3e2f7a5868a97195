"""Helpers that the training-data operators share: shared scratch space, scans, seeded folds."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table's whole scan; Catalyst prunes columns."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. A folder of our own is made only where the session names none
    and runs in this one process (tests); elsewhere that is an error, since executors would not see it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="quillstack-")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """df, computed once: its rows are written to the shared folder, and what reads them has no lineage before that.

    `drop` deletes the rows when a later step has replaced them. Spark's cleaner frees shuffle files only as the driver's JVM
    collects garbage, which an iterative job hardly makes it do; so each cut asks for a collection.
    """
    out = table(df, name, compression="zstd")
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as each write ends. A collection comes too early for them where a listener still holds the
    write's plan, and then they stay until the next. Only for steps that write and read tables: a frame that ran would make its files again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def drop(*tables: DataFrame) -> None:
    """Delete what `table` or `cut` wrote for these, through Hadoop's file systems. Nothing may read them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write as Parquet in the shared folder under a fresh name and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def parts(spark: SparkSession) -> int:
    """The cluster's own sizing of shuffles."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def even_keys(spark: SparkSession, n: int, each: int = 1) -> list[int]:
    """n * each different ints that Spark's hash partitioning deals to n partitions, `each` to every one."""
    if n > 5000:
        return list(range(n * each))
    found: dict[int, list[int]] = {}
    lo, step = 0, 20 * n * each
    while len(found) < n or min(map(len, found.values())) < each:
        ids = spark.range(lo, lo + step, numPartitions=1).select(F.col("id").cast("int").alias("id"))
        for r in ids.select("id", F.pmod(F.hash("id"), F.lit(n)).alias("to")).collect():
            found.setdefault(r["to"], []).append(r["id"])
        lo += step
    return [k for i in range(each) for k in (found[j][i] for j in range(n))]


def fold(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id's decimal text modulo n (null: of the empty text)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], dict | None], schema: str, at_once: int = 1024) -> DataFrame:
    """mapInArrow with a function from one batch, of at most so many rows, to named columns."""
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                if (out := rows(batch.slice(at, at_once))) is not None:
                    yield to_batch(out, target)
        release()

    return df.mapInArrow(run, schema)


def release() -> None:
    """Give back to the system what this worker has freed: workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def to_batch(columns: dict, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c := columns[f.name], pa.Array) else pa.array(c, type=f.type, from_pandas=True) for f in target], schema=target)


def binary_column(chunks: list[bytes]) -> pa.Array:
    return pa.array(chunks, type=pa.binary())


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, held_out: Column, most: tuple[int, int], most_bytes: int = 64_000_000) -> tuple[list[str], np.ndarray, float]:
    """(texts, 0/1 labels, share of label 1 among all learnable labels).

    At most most[y] rows with label y, the lowest by a hash of the id, and of those, in that order, what fits most_bytes
    of text together: the driver holds a bounded sample, whatever the corpus. Texts in it are whole. The share of label 1
    covers all learnable rows. Repeated labels: the largest counts. Repeated ids: the least text counts, null first.
    """
    lab = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    lab = lab.where(~held_out & F.col("y").isin(0, 1))
    shares = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count("*").alias("n")).collect()}
    picked = None
    for y in (0, 1):
        one = lab.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most[y])
        picked = one if picked is None else picked.unionByName(one)
    # at most sum(most) narrow rows, so the broadcast is bounded
    met = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    held = table(met.groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    sizes = held.select("doc_id", F.octet_length("text").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    fits = np.cumsum([r["n"] for r in sizes]) <= most_bytes
    chosen = {r["doc_id"] for r, fit in zip(sizes, fits, strict=True) if fit}
    if len(chosen) < len(sizes):
        held = held.join(F.broadcast(documents.sparkSession.createDataFrame([(i,) for i in chosen], held.select("doc_id").schema)), "doc_id")
    rows = held.select("doc_id", "text", "y").collect()
    rows.sort(key=lambda r: r["doc_id"])
    total = sum(shares.values())
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.int64), (shares.get(1, 0) + 0.5) / (total + 1.0)


#: Bits of the bitmaps that are sent to all tasks, as buckets of Spark's bitmap functions (32768 bits each): two megabytes.
BITMAP_BUCKETS = 512


def marks(hashes: DataFrame) -> DataFrame:
    """(bucket, bits): a bitmap of fixed size of the only column of hashes."""
    place = F.pmod(F.col(hashes.columns[0]), F.lit(BITMAP_BUCKETS * 32768))
    placed = hashes.select(F.floor(place / 32768).cast("int").alias("bucket"), (place % 32768).alias("at"))
    return cut(placed.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")), "bitmap")


def marked(df: DataFrame, bits: DataFrame, column: str = "h1") -> DataFrame:
    """The rows of df whose hash is in the bitmap, and some others; at most BITMAP_BUCKETS rows of 4 kB are broadcast."""
    place = F.pmod(F.col(column), F.lit(BITMAP_BUCKETS * 32768))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(floor(__at / 8) as int) + 1, 1)")), 16, 10).cast("int")
    dealt = df.withColumns({"__at": place % 32768, "bucket": F.floor(place / 32768).cast("int")})
    return dealt.join(F.broadcast(bits), "bucket").where(F.shiftright(byte, 0).bitwiseAND(F.expr("shiftleft(1, cast(__at % 8 as int))")) != 0).drop("bucket", "bits", "__at")


def flagged(df: DataFrame, bits: DataFrame, column: str, name: str) -> DataFrame:
    """df and whether the hash is in the bitmap, which some others are taken to be too; as many rows are broadcast as in `marked`, as longs."""
    longs = F.expr("transform(sequence(0, 511), i -> cast(conv(hex(substring(bits, 8 * i + 1, 8)), 16, -10) as bigint))")
    place = F.col(column).bitwiseAND(F.lit(BITMAP_BUCKETS * 32768 - 1))
    dealt = df.withColumns({"__at": place.bitwiseAND(F.lit(32767)).cast("int"), "__own": F.shiftright(place, 15).cast("int")})
    met = dealt.join(F.broadcast(bits.select(F.col("bucket").alias("__bucket"), longs.alias("__longs"))), F.col("__own") == F.col("__bucket"), "left")
    # a long's first byte is its highest
    bit = F.expr("(shiftright(get(__longs, shiftright(__at, 6)), 56 - (__at & 56) + (__at & 7)) & 1) = 1")
    return met.withColumn(name, F.coalesce(bit, F.lit(False))).drop("__at", "__own", "__bucket", "__longs")


def unique_name(taken: list[str], name: str) -> str:
    """name, with underscores in front until no column has it (whatever the case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
