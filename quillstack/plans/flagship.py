"""The flagship: documents to chunks, chunks to vectors, a question's ten best documents with the passage that won."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.functions import text, vectors
from quillstack.operators.chunks import documents_to_chunks
from quillstack.retrieval.vector import EVIDENCE, max_pool, top_k


def ranked_documents(spark: SparkSession, sf_dir: str, question: str = "the of and inthe thereof", limit: int = 10) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where(text.present("text"))
    chunks = documents_to_chunks(docs, "doc_id", ["text"])
    asked = vectors.hashed_bag(text.words(F.lit(question)))
    scored = chunks.withColumn("score", F.round(vectors.dot(vectors.hashed_bag(text.words("text")), asked), 6))
    pooled = max_pool(scored, ["doc_id"], "score", "chunk_index", ["text"])
    return top_k(pooled, [], limit).select("doc_id", "rank", "score", F.col("best_pos").alias("chunk_index"), F.substring("text", 1, EVIDENCE).alias("passage"))
