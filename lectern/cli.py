"""python -m lectern.cli: build, retrieve, generate, gate."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import chunking, encoding, evaluation, generation, judging, metrics, retrieval
from lectern.sources import files
from lectern.sources.runs import run_id
from lectern.sources.scratch import written

KEYS = ["doc_id", "chunk_index"]
RETRIEVERS = ["dense", "bm25", "hybrid"]


def retriever(spark: SparkSession, docs: DataFrame, strategy: str, name: str, lines: DataFrame | None = None, model: str = "hash64", candidates: int = 50) -> tuple[Callable, DataFrame]:
    """(retrieve, chunks) of a strategy's chunks of documents; the chunks are made once.

    ``lines`` (doc_id, line_no, page_number, line), which joined by newlines are the documents, give chunks their
    pages; without them pages are null.
    """
    made = chunking.STRATEGIES[strategy](docs)
    made = chunking.page_ranges(made, chunking.line_spans(lines)) if lines is not None else made
    page = lambda c: F.col(c).cast("int").alias(c) if lines is not None else F.lit(None).cast("int").alias(c)
    chunks = written(made.select(*KEYS, "text", chunking.chunk_id(F.col("doc_id"), strategy).alias("chunk_id"), page("start_page"), page("end_page")), "chunks")
    vectors = chunks.select(retrieval.chunk_number(F.col("doc_id"), F.col("chunk_index")).alias("vec_id"), F.lit(0).alias("label"), encoding.encode_passages(F.col("text"), model).alias("embedding"), *KEYS)
    asked = lambda q: q.select((-1 - F.col("qid")).alias("vec_id"), F.lit(0).alias("label"), encoding.encode_queries(F.col("text"), model).alias("embedding"))
    return retrieval.retrievers(chunks, vectors, KEYS, asked, candidates)[name], chunks


def numbered(questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Questions with numbers as qids, in the order of their own, and (qid, own) of these. A list of questions is
    small; two that share a qid share the number."""
    own = questions.select("qid").distinct().orderBy("qid").collect()
    kind = questions.schema["qid"].dataType.simpleString()
    names = questions.sparkSession.createDataFrame([(i, r.qid) for i, r in enumerate(own)], f"qid long, own {kind}")
    return questions.withColumnRenamed("qid", "own").join(F.broadcast(names), "own").drop("own"), names


def gate(baseline: dict | None, recall_at_5: float, faithfulness: float | None) -> tuple[int, str]:
    """Exit code and message: 1 for a regression or a missing baseline. A faithfulness that isn't measured, now or
    then, isn't compared, and the message says so."""
    if baseline is None:
        return 1, "no baseline; write one with a reason"
    checks = [("recall@5", baseline["recall_at_5"], recall_at_5, metrics.RECALL_DROP), ("faithfulness", baseline.get("faithfulness"), faithfulness, metrics.FAITH_DROP)]
    failed = [f"{name} {was:.4f} -> {now:.4f}" for name, was, now, drop in checks if was is not None and now is not None and round(was - now, 9) > drop]
    left_out = [name for name, was, now, _ in checks if was is None or now is None]
    note = f" ({', '.join(left_out)} not compared)" if left_out else ""
    return (1, "regression: " + ", ".join(failed) + note) if failed else (0, "no regression" + note)


def _hits(args, spark: SparkSession, questions: DataFrame, k: int, rerank: bool) -> tuple[DataFrame, DataFrame]:
    """Ranked hits of questions (qid, question) with their chunks' columns, and the chunks."""
    lines = spark.read.parquet(args.lines) if args.lines else None
    found, chunks = retriever(spark, spark.read.parquet(args.documents), args.strategy, args.retriever, lines, args.model, args.candidate_k)
    queries = written(questions.select("qid", F.col("question").alias("text")), "queries")
    hits = found(queries, args.candidate_k if rerank else k)
    hits = retrieval.RERANKERS[args.reranker](hits, queries, chunks, KEYS, k) if rerank else hits
    return written(hits.select("qid", *KEYS, "rank", "score").join(chunks, KEYS), "hits"), chunks


def answers(args, spark: SparkSession, questions: DataFrame, rerank: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Answer rows, their sweep, and context records of all questions, answerable or not."""
    hits, _ = _hits(args, spark, questions, args.max_k, rerank)
    rows, contexts = generation.run(questions, hits, generation.GENERATORS[args.generator], min(5, args.max_k))
    rows = written(rows, "answers")
    swept = metrics.tau_sweep(rows.select(F.col("top_rerank_score").alias("score"), "answerable", F.col("model_abstained").alias("abstained"), F.col("gold_answer_found").alias("correct")))
    return rows, swept, contexts


def faithfulness(rows: DataFrame, questions: DataFrame, contexts: DataFrame, judge: Callable = judging.score_by_overlap) -> float | None:
    """The mean faithfulness of answers that don't abstain, by ``judge`` of their records; null if none is scored."""
    records = judging.faithfulness_records(rows, questions, contexts).withColumn("reference", F.lit(None).cast("string"))
    return judge(records).where("metric = 'faithfulness'").agg(F.avg("score")).first()[0]


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lectern")
    sub = out.add_subparsers(dest="command", required=True)
    build = sub.add_parser("build", help="chunks of all strategies and their manifest")
    build.add_argument("documents")
    build.add_argument("out")
    retrieve, generate, check = (sub.add_parser(name, help=what) for name, what in (("retrieve", "question rows and metrics of a retriever"), ("generate", "answers, their sweep and contexts"), ("gate", "exit code 1 for a regression")))
    for p in (retrieve, generate, check):
        p.add_argument("documents")
        p.add_argument("questions")
        p.add_argument("--strategy", choices=sorted(chunking.STRATEGIES), default="section_aware")
        p.add_argument("--retriever", choices=RETRIEVERS, default="bm25")
        p.add_argument("--model", default="hash64", help="a registered encoder")
        p.add_argument("--candidate-k", type=int, default=50, help="hits that are ranked anew, or fused")
        p.add_argument("--max-k", type=int, default=10)
        p.add_argument("--reranker", choices=sorted(retrieval.RERANKERS), default="overlap")
        p.add_argument("--generator", choices=sorted(generation.GENERATORS), default="extractive")
        p.add_argument("--lines", help="Parquet of (doc_id, line_no, page_number, line), for pages")
    retrieve.add_argument("--rerank", action="store_true")
    generate.add_argument("--no-rerank", action="store_true")
    retrieve.add_argument("out")
    generate.add_argument("out")
    check.add_argument("--baseline", default="baseline.json")
    check.add_argument("--update-baseline", metavar="REASON")
    check.add_argument("--skip-faithfulness", action="store_true")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "build":
        print(files.build_corpus(spark.read.parquet(args.documents), args.out))
        return 0
    questions, names = numbered(files.read_questions(spark, args.questions))
    own = lambda rows: rows.join(F.broadcast(names), "qid").withColumn("qid", F.col("own")).drop("own")
    if args.command == "generate":
        rows, swept, contexts = answers(args, spark, questions, not args.no_rerank)
        name = run_id(args.strategy, args.model, args.retriever, rerank=not args.no_rerank, generation=True)
        files.write_generation_run(own(rows), swept, own(contexts), generation.diagnostics(rows).first().asDict() | {"run_id": name}, f"{args.out}/{name}")
        return 0
    asked = evaluation.answerable(questions)
    rerank = args.command == "retrieve" and args.rerank
    hits, _ = _hits(args, spark, asked, args.max_k, rerank)
    rows = evaluation.question_rows(hits, asked)
    scored = evaluation.run_metrics(rows).first()
    if args.command == "retrieve":
        name = run_id(args.strategy, args.model, args.retriever, rerank=rerank)
        files.write_csv_run(own(rows), scored.asDict() | {"run_id": name}, f"{args.out}/{name}")
        print(scored)
        return 0
    said = None
    if not args.skip_faithfulness:
        made, _, contexts = answers(args, spark, questions, True)
        said = faithfulness(made, questions, contexts)
    if args.update_baseline is not None:
        files.write_baseline(args.baseline, {"strategy": args.strategy, "retriever": args.retriever}, scored.recall_at_5, said, args.update_baseline)
        return 0
    code, message = gate(files.read_baseline(args.baseline), scored.recall_at_5, said)
    print(message)
    return code


if __name__ == "__main__":
    sys.exit(main())
