"""All-string scans of delimited text: delimiter detection, quoted multi-line cells, null tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

DELIMITERS = "|,;\t"
#: Cell texts that read as null (fixed values of the common CSV readers).
NULL_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def header_line(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    return (first[0][0] or "").lstrip("\ufeff") if first else ""


def detect_delimiter(header: str) -> str:
    """The candidate that occurs most often outside quotes; a comma if none does."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for c in header:
        if c == '"':
            quoted = not quoted
        elif c in counts and not quoted:
            counts[c] += 1
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def read_delimited(spark: SparkSession, path: str, columns: list[str] | None = None, delimiter: str | None = None) -> DataFrame:
    """Every column a string; doubled quotes, embedded line ends and cells of any size; null tokens become null."""
    header = header_line(spark, path) if columns is None or delimiter is None else ""
    delimiter = delimiter or detect_delimiter(header)
    columns = columns or _names(header, delimiter)
    schema = StructType([StructField(c, StringType()) for c in columns])
    df = spark.read.schema(schema).options(sep=delimiter, header=True, multiLine=True, quote='"', escape='"', maxCharsPerColumn=-1, mode="PERMISSIVE", encoding="UTF-8").csv(path)
    return df.select(*(F.when(F.col(f"`{c}`").isin(*NULL_TOKENS), None).otherwise(F.col(f"`{c}`")).alias(c) for c in columns))


def _names(header: str, delimiter: str) -> list[str]:
    import csv

    return next(csv.reader([header], delimiter=delimiter), [])


def write_delimited(df: DataFrame, path: str, delimiter: str = "|") -> None:
    df.write.options(sep=delimiter, header=True, quote='"', escape='"', quoteAll=True).csv(path)
