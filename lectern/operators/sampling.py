"""Drawing questions: pools, quotas, pairs of passages, and the checks of drafts.

A drafter is a function from passages to their JSON answers; calls to a model stand behind it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug, span_form
from lectern.operators.matching import match_in_rounds
from lectern.sources.scratch import written


def gold_pages(start: Column, end: Column) -> Column:
    """The first and last page of a passage, in order, once if they are one."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(start, end))))


def fill_quota(pool: DataFrame, quota: DataFrame, by: list[str]) -> DataFrame:
    """The first rows by rank of each group, as many as its quota: pool (by, chunk_id, rank, accepted), quota (by, quota)."""
    turn = F.row_number().over(Window.partitionBy(*by).orderBy("rank", "chunk_id"))
    return pool.where("accepted").join(quota, by).withColumn("turn", turn).where(F.col("turn") <= F.col("quota")).drop("turn")


def shortfalls(filled: DataFrame, quota: DataFrame, by: list[str]) -> DataFrame:
    """(by, quota, n, missing) of each group."""
    n = filled.groupBy(*by).agg(F.count("*").alias("n"))
    return quota.join(n, by, "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("missing", F.col("quota") - F.col("n"))


def fill_in_order(pool: DataFrame, quotas: list[tuple[str, DataFrame]], by: str) -> DataFrame:
    """Kinds in turn: each takes its quota of the pool (kind, by, chunk_id, rank, accepted) from chunks that no
    kind before has taken. As many rounds as kinds."""
    taken = None
    for kind, quota in quotas:
        left = pool.where(F.col("kind") == kind)
        left = left if taken is None else left.join(taken.select("chunk_id"), "chunk_id", "left_anti")
        got = fill_quota(left, quota, [by]).select("kind", by, "chunk_id", "rank")
        taken = got if taken is None else taken.unionByName(got)
    return taken


def fill_comparative(pairs: DataFrame, used: DataFrame, quota: int = 10) -> DataFrame:
    """(a, b, rank): the first ``quota`` accepted pairs by rank, no passage in two of them or in ``used`` (chunk_id).

    ``pairs`` (a, b, rank, accepted) are drafts of two passages. Pairs of one rank are in the order of a, then b; pairs
    with a null passage or rank, or of a passage with itself, are left out.
    """
    open_ = pairs.select("a", "b", "rank", "accepted").where("accepted").join(used.select(F.col("chunk_id").alias("a")), "a", "left_anti").join(used.select(F.col("chunk_id").alias("b")), "b", "left_anti")
    open_ = written(open_, "drafts")
    one = F.lit(0)
    made = match_in_rounds(open_.select("a", "b", one.alias("group_a"), one.alias("group_b"), (-F.col("rank").cast("double")).alias("score")), quota)
    return made.join(open_.select("a", "b", "rank").distinct(), ["a", "b"]).where((-F.col("rank").cast("double")) == F.col("score")).select("a", "b", "rank")


def candidate_pool(chunks: DataFrame, used: DataFrame, by: str, first: dict[str, Column], size: int, seed: int = 0) -> DataFrame:
    """(qtype, by, chunk_id, rank): for each question type the ``size`` first chunks of a group, those that its test in
    ``first`` holds for before the others, each in an order of hashes that the seed decides; without ``used`` chunks.

    ``chunks`` has chunk_id, by, and what the tests look at; a test that is null doesn't hold.
    """
    kinds = F.array(*(F.struct(F.lit(q).alias("qtype"), F.coalesce(test, F.lit(False)).alias("primary")) for q, test in first.items()))
    rows = chunks.join(used.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", by, F.explode(kinds).alias("k")).select("chunk_id", by, "k.*")
    order = [F.desc("primary"), F.md5(F.concat_ws(":", F.lit(str(seed)), "qtype", "chunk_id")), F.asc("chunk_id")]
    nth = F.row_number().over(Window.partitionBy("qtype", by).orderBy(*order))
    return rows.withColumn("rank", nth).where(F.col("rank") <= size).select("qtype", by, "chunk_id", "rank")


def draft_reason(draft: Column, text: Column) -> Column:
    """Why a draft (JSON) for a passage is turned down, the first reason that holds; null for a good one."""
    field = lambda name: F.get_json_object(draft, f"$.{name}")
    required = ["question", "gold_span", "gold_answer"]
    kinds = F.from_json(draft, "map<string,string>")
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys(kinds))
    text_like = lambda name: draft.rlike(f'"{name}"\\s*:\\s*"')
    empty = F.lit(False)
    for name in required:
        empty = empty | ~text_like(name) | (F.trim(F.coalesce(field(name), F.lit(""))) == "")
    return (
        F.when(draft.isNull(), "api_error")
        .when(kinds.isNull() | ~F.trim(draft).startswith("{"), "malformed_response")
        .when(F.lower(F.coalesce(field("skip"), F.lit("false"))).isin("true", "1"), F.concat(F.lit("model_skipped: "), F.coalesce(field("reason"), F.lit(""))))
        .when(F.size(missing) > 0, F.concat(F.lit("missing_keys: "), F.array_join(F.array_sort(missing), ",")))
        .when(empty, "empty_or_non_string_field")
        .when(~span_form(text).contains(span_form(field("gold_span"))), "span_not_verbatim")
    )


def drafted(passages: DataFrame, qtype: str) -> DataFrame:
    """Questions of passages (chunk_id, text, start_page, end_page, draft) whose drafts are good, in canonical shape."""
    field = lambda name: F.get_json_object("draft", f"$.{name}")
    good = passages.where(draft_reason(F.col("draft"), F.col("text")).isNull())
    evidence = F.array(F.struct(slug(F.col("chunk_id")).alias("paper"), field("gold_span").alias("span"), gold_pages(F.col("start_page"), F.col("end_page")).alias("pages"), F.col("chunk_id").alias("source_chunk_id")))
    return good.select(F.trim(field("question")).alias("question"), F.lit(qtype).alias("qtype"), F.lit(True).alias("answerable"), F.trim(field("gold_answer")).alias("gold_answer"), F.lit(False).alias("reviewed_by_human"), evidence.alias("evidence"))


def comparative_reason(draft: Column, text_a: Column, text_b: Column) -> Column:
    """As draft_reason() for a draft about two passages: each span must stand in its own."""
    field = lambda name: F.get_json_object(draft, f"$.{name}")
    kinds = F.from_json(draft, "map<string,string>")
    blank = lambda name: F.trim(F.coalesce(field(name), F.lit(""))) == ""
    required = ["question", "gold_span_a", "gold_span_b", "gold_answer"]
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys(kinds))
    return (
        F.when(draft.isNull(), "api_error")
        .when(kinds.isNull() | ~F.trim(draft).startswith("{"), "malformed_response")
        .when(F.size(missing) > 0, F.concat(F.lit("missing_keys: "), F.array_join(F.array_sort(missing), ",")))
        .when(blank("question") | blank("gold_span_a") | blank("gold_span_b") | blank("gold_answer"), "empty_or_non_string_field")
        .when(~span_form(text_a).contains(span_form(field("gold_span_a"))), "span_a_not_verbatim")
        .when(~span_form(text_b).contains(span_form(field("gold_span_b"))), "span_b_not_verbatim")
    )


def with_qids(questions: DataFrame, *order: str) -> DataFrame:
    """``questions`` with qid q0000, q0001 and on, in a total order; a list of questions is small."""
    nth = F.row_number().over(Window.orderBy(*order)) - 1
    return questions.withColumn("qid", F.format_string("q%04d", nth))


def call_with_retry(call: Callable[[], str], retries: int = 3, pause: float = 1.5, sleep: Callable[[float], None] = time.sleep) -> str | None:
    """What ``call`` gives; after ``retries`` failures null. The pause grows by ``pause`` seconds each time."""
    for attempt in range(1, retries + 1):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if attempt < retries:
                sleep(pause * attempt)
    return None
