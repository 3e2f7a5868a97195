"""An append-only landing folder as a stream: new JSON lines, each content once, appended to a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def landing(spark: SparkSession, folder: str, schema: StructType, text: str = "text", files_per_trigger: int = 1000) -> DataFrame:
    """Rows of new files with `sha256` of their text."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(folder).withColumn("sha256", F.sha2(F.coalesce(text, F.lit("")), 256))


def append_once(rows: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends contents that neither the batch nor the table has; a batch run again adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["sha256"])
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.parquet(table).select("sha256"), "sha256", "left_anti")
        fresh.write.mode("append").parquet(table)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
