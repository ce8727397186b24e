"""Retrieval metrics, abstention sweeps, quotas and the regression check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import span_form

CUTS = (1, 3, 5, 10)
#: Drops of recall and of faithfulness that still pass.
RECALL_DROP, FAITH_DROP = 0.02, 0.05
#: Ranges of scores that are swept side by side.
PARTS = 256


def form(df: DataFrame, text: str, norm: str) -> Column:
    """The form in which spans are matched: the column that text.with_span_form() has made, else for text in NFKC."""
    return F.col(norm) if norm in df.columns else span_form(F.col(text))


def first_ranks(hits: DataFrame, spans: DataFrame) -> DataFrame:
    """(qid, rank_found): the first hit (qid, rank, text[, norm_text]) whose text has the span (qid, span[, norm_span]);
    null if none has."""
    found = hits.join(spans, "qid").where(form(hits, "text", "norm_text").contains(form(spans, "span", "norm_span"))).groupBy("qid").agg(F.min("rank").alias("rank_found"))
    return spans.select("qid").distinct().join(found, "qid", "left")


def all_evidence(ranks: DataFrame) -> DataFrame:
    """(qid, rank_found): the worst of a question's ranks (qid, evidence, rank); null if one is missing."""
    return ranks.groupBy("qid").agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("rank_found"))


def recall(k: int) -> Column:
    return F.coalesce(F.avg(F.when(F.col("rank_found") <= k, 1.0).otherwise(0.0)), F.lit(0.0))


def mrr(k: int = 10) -> Column:
    return F.coalesce(F.avg(F.when(F.col("rank_found") <= k, 1.0 / F.col("rank_found")).otherwise(0.0)), F.lit(0.0))


def summary() -> list[Column]:
    return [*(F.round(recall(k), 6).alias(f"recall_at_{k}") for k in CUTS), F.round(mrr(), 6).alias("mrr_at_10"), F.count("*").alias("n_questions"), F.count("rank_found").alias("n_hits")]


def by_position(rows: DataFrame, by: str, value: str, p: float, name: str, rounded: bool = True) -> DataFrame:
    """(by, name): the value at 0-based position round(p * (n - 1)), or min(n - 1, floor(p * n)) if not ``rounded``.

    From counts of distinct values: no sort of all rows. Nulls don't count.
    """
    each = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(by)
    run = each.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    at = F.bround(p * (F.col("_n") - 1)) if rounded else F.least(F.col("_n") - 1, F.floor(p * F.col("_n")))
    return run.where((at >= F.col("_upto") - F.col("_c")) & (at < F.col("_upto"))).select(by, F.col(value).alias(name))


def tau_grid(rows: DataFrame, score: str = "score") -> DataFrame:
    """(tau): distinct scores, one below the least and one above the largest; 0 if there are none."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).select(F.explode(F.when(F.col("lo").isNull(), F.array(F.lit(0.0))).otherwise(F.array(F.col("lo") - 1, F.col("hi") + 1))).alias("tau"))
    return rows.where(F.col(score).isNotNull()).select(F.col(score).alias("tau")).union(ends).distinct()


def combined_abstained(abstained: Column, score: Column, tau: Column) -> Column:
    """Whether the answer abstains or its score is under tau; a null score never is."""
    return abstained | F.coalesce(score < tau, F.lit(False))


def tau_sweep(rows: DataFrame) -> DataFrame:
    """Per tau, of rows (score, answerable, abstained, correct): rates with answers under tau withheld.

    Answers that stay are those not abstained whose score is null or tau or more, so each count is a total
    less a running sum over scores in order: of a row for each distinct score, not scores times rows. The scores lie in
    PARTS ranges, of which each is summed up by itself and begins with the sums of those below.
    """
    says, asked = ~F.col("abstained"), F.col("answerable")
    judged = asked & says & F.col("correct").isNotNull()
    counts = {"qa": asked & says, "qu": ~asked & says, "qj": judged, "qc": judged & F.col("correct")}
    total = rows.agg(*(F.count_if(c).alias(f"all_{k}") for k, c in counts.items()), F.count_if(asked).alias("n_answerable"), F.count_if(~asked).alias("n_unanswerable"))
    each = rows.where(F.col("score").isNotNull()).groupBy(F.col("score").alias("tau")).agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    grid = tau_grid(rows).join(each, "tau", "left").fillna(0, list(counts))
    ends = rows.agg((F.min("score") - 2).alias("lo"), (F.max("score") + 2).alias("hi"))
    ranged = grid.crossJoin(F.broadcast(ends)).withColumn("part", F.coalesce(F.width_bucket("tau", "lo", "hi", F.lit(PARTS)), F.lit(0)))
    below = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows
    sums = ranged.groupBy("part").agg(*(F.sum(k).alias(k) for k in counts)).select("part", *(F.coalesce(F.sum(k).over(below), F.lit(0)).alias(f"below_{k}") for k in counts))
    under = Window.partitionBy("part").orderBy("tau").rowsBetween(Window.unboundedPreceding, -1)
    run = ranged.join(F.broadcast(sums), "part").select("tau", *((F.coalesce(F.sum(k).over(under), F.lit(0)) + F.col(f"below_{k}")).alias(k) for k in counts)).crossJoin(F.broadcast(total))
    left = lambda k: F.col(f"all_{k}") - F.col(k)
    rate = lambda n, d: F.when(d > 0, F.round(n / d, 6)).otherwise(0.0)
    a, u = F.col("n_answerable"), F.col("n_unanswerable")
    return run.select("tau", rate(a - left("qa"), a).alias("false_abstention_rate"), rate(u - left("qu"), u).alias("true_abstention_rate"), (u - left("qu")).alias("n_true_abstained"), "n_unanswerable", F.when(left("qj") > 0, F.round(1 - left("qc") / left("qj"), 6)).alias("error_rate"), left("qj").alias("n_judged"))


def apportion(groups: DataFrame, quota: DataFrame, by: str, size: str = "n") -> DataFrame:
    """(qtype, by, quota) by largest remainders of quota (qtype, total) over groups (by, size); ties by name."""
    whole = groups.agg(F.sum(size).alias("whole"))
    exact = quota.crossJoin(groups).crossJoin(F.broadcast(whole)).withColumn("exact", F.col("total") * F.col(size) / F.col("whole"))
    base = exact.withColumn("base", F.floor("exact")).withColumn("rest", F.round(F.col("exact") - F.col("base"), 9))
    w = Window.partitionBy("qtype")
    left = F.col("total") - F.sum("base").over(w)
    turn = F.row_number().over(w.orderBy(F.desc("rest"), by))
    return base.withColumn("quota", F.col("base") + F.when(turn <= left, 1).otherwise(0)).select("qtype", by, "quota")


def regression(baseline: DataFrame, now: DataFrame, recall_drop: float = RECALL_DROP, faith_drop: float = FAITH_DROP) -> DataFrame:
    """One row: both tables' recall_at_5 and faithfulness, and passed. A drop of just the tolerance passes."""
    b = baseline.select(F.col("recall_at_5").alias("base_recall"), F.col("faithfulness").alias("base_faithfulness"))
    both = now.select("recall_at_5", "faithfulness").crossJoin(b)
    ok = F.round(F.col("base_recall") - F.col("recall_at_5"), 9) <= recall_drop
    faith = F.coalesce(F.round(F.col("base_faithfulness") - F.col("faithfulness"), 9) <= faith_drop, F.lit(True))
    return both.withColumn("passed", ok & faith)
