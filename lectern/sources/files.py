"""Files: sorted listings, documents, chunks, questions, contexts, runs, collections, reports, baselines, provenance."""

from __future__ import annotations

import json
import os
import subprocess
from collections.abc import Callable
from datetime import datetime, timezone
from hashlib import sha256
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import is_non_content
from lectern.operators.evaluation import EVIDENCE
from lectern.sources.runs import read_chunks

BLOCKS = "source_file string, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, block_type int, page_width double"
CONTEXTS = "qid string, context_chunk_ids array<string>, context_pages array<array<int>>, context_scores array<double>, context_texts array<string>"


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match, in order; none is an error."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    names = sorted(f.getPath().toString() for f in found or [])
    if not names:
        raise FileNotFoundError(pattern)
    return names


def scan_documents(spark: SparkSession, pattern: str, parse: Callable[[bytes], list[tuple]]) -> DataFrame:
    """Text blocks of binary documents. ``parse`` gives (page_number, block_no, x0, y0, x1, y1, text, block_type,
    page_width) of a file's bytes; it is the parser that an installation has. Images and blank blocks are left out."""
    files = spark.read.format("binaryFile").load(list_files(spark, pattern)).select("path", "content")

    def run(frames):
        import pandas as pd

        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame([(path.rsplit("/", 1)[-1], *b) for b in parse(content)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return files.mapInPandas(run, BLOCKS).where((F.col("block_type") == 0) & (F.trim("text") != ""))


def write_chunks(records: DataFrame, path: str) -> None:
    """Chunk records as JSON lines in a folder for each strategy, which is replaced."""
    records.withColumn("_s", F.col("strategy")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_s").json(path)


def read_content_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk records without references and acknowledgements."""
    return read_chunks(spark, path).where(~is_non_content(F.col("section")))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines, blank lines skipped, in canonical shape: paper, gold_span, gold_pages and
    source_chunk_id are values, or lists of two for a comparison, or null."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    get = lambda name: F.get_json_object("value", f"$.{name}")
    listed = lambda x: F.when(F.substring(F.ltrim(x), 1, 1) == "[", F.from_json(x, "array<string>")).when(x.isNotNull(), F.array(x))
    pages = F.when(F.regexp_like(get("gold_pages"), F.lit(r"^\s*\[\s*\[")), F.from_json(get("gold_pages"), "array<array<int>>")).otherwise(F.array(F.from_json(get("gold_pages"), "array<int>")))
    papers, spans, chunks = listed(get("paper")), listed(get("gold_span")), listed(get("source_chunk_id"))
    some = F.transform(spans, lambda s, i: F.struct(F.get(papers, i).alias("paper"), s.alias("span"), F.get(pages, i).alias("pages"), F.get(chunks, i).alias("source_chunk_id")))
    return raw.select(get("qid").alias("qid"), get("question").alias("question"), get("qtype").alias("qtype"), (get("answerable") == "true").alias("answerable"), get("gold_answer").alias("gold_answer"), (get("reviewed_by_human") == "true").alias("reviewed_by_human"), F.coalesce(some, F.expr(f"cast(array() as {EVIDENCE})")).alias("evidence"))


def by_qid(rows: DataFrame, *order: str) -> DataFrame:
    """One row a qid: the last by ``order``."""
    rest = [c for c in rows.columns if c != "qid"]
    return rows.groupBy("qid").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select("qid", "r.*")


def typed_answers(raw: DataFrame) -> DataFrame:
    """Answer rows of a CSV with their types: an empty score is null, "True" is true."""
    number = lambda c: F.nullif(F.col(c), F.lit("")).cast("double").alias(c)
    flag = lambda c: F.when(F.col(c) != "", F.col(c) == "True").alias(c)
    kinds = {"top_rerank_score": number, "latency_ms": number, "answerable": flag, "model_abstained": flag, "gold_answer_found": flag}
    return raw.select(*(kinds[c](c) if c in kinds else F.col(c) for c in raw.columns))


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTEXTS).json(path)


def write_contexts(contexts: DataFrame, path: str) -> None:
    contexts.write.mode("overwrite").json(path)


def write_csv_run(results: DataFrame, config: dict, path: str) -> None:
    """results as CSV (lists joined by bars, flags as True and False) and config as JSON, replaced."""
    cell = lambda c, kind: F.array_join(c, "|").alias(c) if kind.startswith("array") else F.initcap(F.col(c).cast("string")).alias(c) if kind == "boolean" else F.col(c)
    results.select(*(cell(c, kind) for c, kind in results.dtypes)).coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(f"{path}/results")
    results.sparkSession.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")


def write_generation_run(rows: DataFrame, sweep: DataFrame, contexts: DataFrame, config: dict, path: str) -> None:
    """An answering run's four tables."""
    write_csv_run(rows, config, path)
    sweep.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/tau_sweep")
    write_contexts(contexts, f"{path}/contexts")


def metadata(records: DataFrame) -> DataFrame:
    """What a collection keeps of a chunk beside its vector."""
    return records.select("chunk_id", "content_hash", "source_file", "strategy", "chunk_index", "start_page", "end_page", "section", "single_token_line_ratio", "token_count", "truncated")


def build_collection(records: DataFrame, encode: Callable[[Column], Column], model: str, path: str) -> int:
    """Vectors and metadata of chunk records (with token_count, truncated) under ``path``, the strategy's and model's
    partition replaced; how many. A count other than the records' is an error."""
    vectors = metadata(records).join(records.select("chunk_id", "text", encode(F.col("text")).alias("embedding")), "chunk_id").withColumn("model_slug", F.lit(model))
    vectors.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("strategy", "model_slug").parquet(path)
    wanted, strategies = records.count(), [r[0] for r in records.select("strategy").distinct().collect()]
    made = read_collection(records.sparkSession, path).where((F.col("model_slug") == model) & F.col("strategy").isin(strategies)).count()
    if made != wanted:
        raise ValueError(f"{made} vectors of {wanted} chunks")
    return made


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_collections(records: DataFrame, encoders: dict[str, Callable[[Column], Column]], path: str) -> dict[str, int]:
    """build_collection() for each encoder; vectors by encoder."""
    return {name: build_collection(records, encode, name, path) for name, encode in encoders.items()}


def store_path(setting: str = "LECTERN_STORE", default: str = "store") -> str:
    """The collections' folder: from the environment, else a folder in the working one."""
    return os.environ.get(setting) or str(Path.cwd() / default)


def score_report(scores: DataFrame) -> str:
    """Markdown of aggregate_scores() with run_id: a row a run, a column a metric."""
    rows = scores.orderBy("run_id", "metric").collect()
    names = sorted({r.metric for r in rows})
    cell = lambda r: "-" if r.mean is None else f"{r.mean:.4f} (n={r.n_scored}/{r.n_total})"
    by = {(r.run_id, r.metric): cell(r) for r in rows}
    lines = ["| run | " + " | ".join(names) + " |", "|" + "---|" * (len(names) + 1)]
    return "\n".join([*lines, *(f"| {run} | " + " | ".join(by.get((run, n), "-") for n in names) + " |" for run in sorted({r.run_id for r in rows}))])


def audit(ordered: DataFrame, pages: tuple[int, ...] = (3, 8, 15), characters: int = 500) -> DataFrame:
    """(doc, layout, n_single, n_double, n_unclear, samples) of ordered blocks: a letter a page, S or D, or ? where it
    has fewer than two blocks, and how some pages begin."""
    page = ordered.groupBy("doc", "page").agg(F.count("*").alias("n"), F.first("layout").alias("layout"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda b: b["text"]), "\n").alias("text"))
    letter = F.when(F.col("n") < 2, "?").when(F.col("layout") == "single", "S").otherwise("D")
    page = page.withColumn("letter", letter)
    sample = F.when(F.col("page").isin(*pages), F.struct("page", F.substring("text", 1, characters).alias("text")))
    return page.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "letter"))), lambda p: p["letter"]), "").alias("layout"), *(F.count_if(F.col("letter") == x).alias(f"n_{name}") for x, name in (("S", "single"), ("D", "double"), ("?", "unclear"))), F.array_sort(F.collect_list(sample)).alias("samples"))


def chunking_report(records: DataFrame) -> DataFrame:
    """(source_file, strategy, n, avg_chars, min_chars, max_chars)."""
    n = F.length("text")
    return records.groupBy("source_file", "strategy").agg(F.count("*").alias("n"), F.round(F.avg(n), 4).alias("avg_chars"), F.min(n).cast("long").alias("min_chars"), F.max(n).cast("long").alias("max_chars"))


def read_baseline(path: str) -> dict | None:
    """The regression check's baseline; null if there is none."""
    return json.loads(Path(path).read_text()) if Path(path).exists() else None


def write_baseline(path: str, config: dict, recall_at_5: float, faithfulness: float | None, reason: str) -> dict:
    """Replace the baseline and add a line to the log beside it; a reason is needed."""
    if not reason.strip():
        raise ValueError("a new baseline needs a reason")
    made = config | {"recall_at_5": recall_at_5, "faithfulness": faithfulness, "reason": reason, "updated_at": datetime.now(timezone.utc).isoformat()}
    Path(path).write_text(json.dumps(made, indent=2))
    with Path(path).with_suffix(".log").open("a") as log:
        log.write(json.dumps(made) + "\n")
    return made


def file_hashes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(list_files(spark, pattern)).select("path", F.sha2("content", 256).alias("sha256"))


def fingerprint(rows: DataFrame, column: str = "content_hash") -> DataFrame:
    """(n, fingerprint) of a table whatever its order: the sum of its values' 64-bit hashes."""
    return rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64(column).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


def provenance(*files: str, root: str = ".") -> dict[str, str]:
    """code_version, the first 12 digits of the files' SHA-256, and git_commit, with -dirty if there are changes."""
    digest = sha256(b"".join(Path(f).read_bytes() for f in files)).hexdigest()[:12]
    try:
        git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, timeout=5, check=True).stdout.strip()
        commit = git("rev-parse", "--short", "HEAD") + ("-dirty" if git("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        commit = "unknown"
    return {"code_version": digest, "git_commit": commit}


def build_corpus(docs: DataFrame, path: str, names: tuple[str, ...] = ("fixed_size", "recursive", "section_aware"), parameters: dict | None = None) -> dict:
    """Chunks of all strategies under ``path``, written once and read back, and a manifest of them.

    What grows with the documents is written as tables beside the chunks, and the manifest names them and their
    number of rows: ``documents`` (source_file, sha256, n_chars), ``by_document`` (strategy, source_file, n) and
    ``collisions`` (chunk_id, n), all of them.
    """
    import platform

    import pyspark

    from lectern.operators import chunking

    spark = docs.sparkSession
    write_chunks(chunking.all_strategies(docs, names), path)
    chunks = read_chunks(spark, path)
    stats = {r.strategy: r.asDict() for r in chunking.statistics(chunks).collect()}
    tables = {
        "documents": docs.select(F.col("doc_id").cast("string").alias("source_file"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("n_chars")),
        "by_document": chunking.by_document(chunks),
        "collisions": chunking.collisions(chunks),
    }
    counts = {}
    for name, df in tables.items():
        place = f"{path.rstrip('/')}-{name}"
        df.write.mode("overwrite").parquet(place)
        counts[name] = {"path": place, "rows": spark.read.schema(df.schema).parquet(place).count()}
    versions = {"python": platform.python_version(), "spark": pyspark.__version__}
    return {"generated_at": datetime.now(timezone.utc).isoformat(), "parameters": parameters or {"strategies": list(names)}, "versions": versions, "strategies": stats, "tables": counts, "chunk_id_collisions": counts["collisions"]["rows"]}
