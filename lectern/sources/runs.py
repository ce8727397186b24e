"""Readers and sinks of chunks, results and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, content_hash string, text string, source_file string, strategy string, chunk_index int, start_page int, end_page int, char_start int, char_end int, section string, single_token_line_ratio double"


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records as JSON lines."""
    return spark.read.schema(CHUNK_SCHEMA).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """A run's per-question CSV with its types: an empty rank is null, ids are split at bars."""
    raw = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    out = raw.withColumn("rank_found", F.nullif("rank_found", F.lit("")).cast("int"))
    for c, how in (("page_overlap_top10", F.col("page_overlap_top10") == "True"), ("top5_context_chars", F.col("top5_context_chars").cast("int")), ("retrieved_chunk_ids", F.split("retrieved_chunk_ids", r"\|"))):
        if c in raw.columns:
            out = out.withColumn(c, how)
    return out


def write_run(results: DataFrame, config: DataFrame, path: str, run_id: str) -> None:
    """results and config under ``path``/results and ``path``/config, the run's partition replaced."""
    for name, df in (("results", results), ("config", config)):
        df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{path}/{name}")


def run_id(strategy: str, model: str, retriever: str, rerank: bool = False, generation: bool = False) -> str:
    """Lexical runs don't name a model."""
    parts = [strategy, *([] if retriever == "bm25" else [model]), retriever + "_rerank" * rerank, *(["generation"] if generation else [])]
    return "__".join(parts)
