"""Records for judges, their scores, and the replay of recorded runs.

A judge is a function of a record's fields to a number; ``overlap`` ones are offline stand-ins.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import tokens

#: Which fields each metric sees.
METRICS = {"faithfulness": ("response", "contexts"), "answer_relevancy": ("user_input", "response"), "context_precision": ("contexts", "reference"), "context_recall": ("reference", "contexts")}


def judge_records(questions: DataFrame, rows: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, user_input, response, retrieved_contexts, reference): answers that don't abstain, to answerable questions
    with a gold answer and contexts. A question given twice counts as its last by gold answer."""
    asked = questions.where(F.coalesce("gold_answer", F.lit("")) != "").groupBy("qid").agg(F.max(F.struct("gold_answer", "question")).alias("q")).select("qid", "q.*")
    said = rows.where(F.col("answerable") & ~F.col("model_abstained")).select("qid", "final_text")
    return said.join(asked, "qid").join(contexts.where(F.size("context_texts") > 0), "qid").select("qid", F.col("question").alias("user_input"), F.col("final_text").alias("response"), F.col("context_texts").alias("retrieved_contexts"), F.col("gold_answer").alias("reference"))


def faithfulness_records(rows: DataFrame, questions: DataFrame, contexts: DataFrame) -> DataFrame:
    """(qid, user_input, response, retrieved_contexts) of answers that don't abstain and have contexts."""
    said = rows.where(~F.col("model_abstained")).select("qid", "final_text").join(questions.select("qid", "question"), "qid")
    return said.join(contexts.where(F.size("context_texts") > 0), "qid").select("qid", F.col("question").alias("user_input"), F.col("final_text").alias("response"), F.col("context_texts").alias("retrieved_contexts"))


def overlap(of: Column, within: Column) -> Column:
    """Share of the distinct terms of one text that stand in another; null without terms."""
    own = F.array_distinct(tokens(of))
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, tokens(within))) / F.size(own))


def score_by_overlap(records: DataFrame) -> DataFrame:
    """(qid, metric, score) of all four metrics, by shares of terms. A stand-in for a model."""
    text = {"contexts": F.array_join("retrieved_contexts", " "), **{c: F.col(c) for c in ("user_input", "response", "reference")}}
    scored = [F.struct(F.lit(name).alias("metric"), overlap(text[a], text[b]).alias("score")) for name, (a, b) in METRICS.items()]
    return records.select("qid", F.explode(F.array(*scored)).alias("s")).select("qid", "s.*")


def score_with(records: DataFrame, judge: Callable[[dict], float | None], metric: str, at_once: int = 8) -> DataFrame:
    """(qid, metric, score): ``judge`` of each record, some at once in each task; null where it fails."""

    def one(record: dict) -> float | None:
        try:
            return judge(record)
        except Exception:  # noqa: BLE001
            return None

    def run(frames):
        with ThreadPoolExecutor(at_once) as pool:
            for f in frames:
                made = list(pool.map(one, f.to_dict("records")))
                yield pd.DataFrame({"qid": f["qid"], "metric": metric, "score": pd.Series(made, index=f.index, dtype="float64")})

    return records.mapInPandas(run, f"qid {records.schema['qid'].dataType.simpleString()}, metric string, score double")


def judge_runs(runs: dict[str, tuple[DataFrame, DataFrame]], questions: DataFrame, judge: Callable[[DataFrame], DataFrame] = score_by_overlap) -> DataFrame:
    """(config, qid, metric, score) of several runs (answer rows, context records) over one list of questions; all runs'
    records are judged in one plan, so that a judge that calls a model is called by all tasks at once. A run without
    records has no rows."""
    out = None
    for name, (rows, contexts) in runs.items():
        part = judge_records(questions, rows, contexts).withColumn("config", F.lit(name))
        out = part if out is None else out.unionByName(part)
    # A record's number tells runs of one question apart; it comes back as (config, qid).
    keyed = out.withColumn("qid", F.struct("config", "qid")).drop("config")
    return judge(keyed).select("qid.config", "qid.qid", "metric", "score")


def aggregate_scores(scores: DataFrame, by: str = "metric") -> DataFrame:
    """(by, mean, n_scored, n_total); nulls count in the total only."""
    some = F.when(~F.isnan("score"), F.col("score"))
    return scores.groupBy(by).agg(F.avg(some).alias("mean"), F.count(some).alias("n_scored"), F.count("*").alias("n_total"))


def verify_replay(contexts: DataFrame, recorded: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(qid, rebuilt, recorded, severity) of contexts (qid, context_scores) whose first score isn't the recorded
    top_rerank_score: soft where the recorded answer abstained, else hard. Two nulls agree."""
    rows = contexts.select("qid", F.get("context_scores", F.lit(0)).alias("rebuilt")).join(recorded.select("qid", F.col("top_rerank_score").alias("recorded"), "model_abstained"), "qid", "left")
    same = (F.col("rebuilt").isNull() & F.col("recorded").isNull()) | F.coalesce(F.abs(F.col("rebuilt") - F.col("recorded")) <= tolerance, F.lit(False))
    return rows.where(~same).select("qid", "rebuilt", "recorded", F.when(F.coalesce("model_abstained", F.lit(False)), "soft").otherwise("hard").alias("severity"))


def rebuild_contexts(blocks: DataFrame, recorded: DataFrame, sink: Callable[[DataFrame], None]) -> DataFrame:
    """Contexts of blocks, handed to ``sink`` unless the replay differs hard from the record; the mismatches."""
    from lectern.operators.generation import context_record

    made = context_record(blocks)
    off = verify_replay(made, recorded)
    if not off.where("severity = 'hard'").isEmpty():
        raise ValueError("the rebuilt contexts are not those of the record")
    sink(made)
    return off
