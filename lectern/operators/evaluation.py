"""Questions, their evidence, and what a run's hits are worth for them.

A question has one canonical shape: (qid, question, qtype, answerable, gold_answer, evidence), evidence an array
of (paper, span, pages, source_chunk_id): one, two for a comparison, none if it can't be answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug, with_span_form
from lectern.operators.metrics import all_evidence, form, mrr, recall

EVIDENCE = "array<struct<paper:string,span:string,pages:array<int>,source_chunk_id:string>>"


def answerable(questions: DataFrame) -> DataFrame:
    return questions.where(F.coalesce("answerable", F.lit(False)))


def evidence_rows(questions: DataFrame) -> DataFrame:
    """(qid, nth, paper, span, pages) of all evidence."""
    return questions.select("qid", F.posexplode("evidence").alias("nth", "e")).select("qid", "nth", "e.paper", "e.span", "e.pages")


def ranks(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, rank_found): the rank by which all of a question's spans are found in hits (qid, rank, text[, norm_text]).
    With norm_text the spans are brought into its form, too."""
    normal = "norm_text" in hits.columns
    each = with_span_form(evidence_rows(questions), "span", "norm_span") if normal else evidence_rows(questions)
    own = hits.select("qid", "rank", "norm_text" if normal else "text")
    found = each.join(own, "qid").where(form(own, "text", "norm_text").contains(form(each, "span", "norm_span"))).groupBy("qid", "nth").agg(F.min("rank").alias("rank"))
    worst = all_evidence(each.select("qid", "nth").join(found, ["qid", "nth"], "left"))
    return questions.select("qid").join(worst, "qid", "left")


def on_page(pages: Column, start: Column, end: Column) -> Column:
    """Whether one of the pages lies from start to end, either way round; no pages or no range is false."""
    return F.coalesce(F.exists(pages, lambda p: p.between(F.least(start, end), F.greatest(start, end))) & start.isNotNull() & end.isNotNull(), F.lit(False))


def page_overlap(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, page_overlap): whether for each piece of evidence some hit (qid, chunk_id, start_page, end_page) of its
    paper is on one of its pages; false without evidence."""
    each = evidence_rows(questions)
    near = each.join(hits.select("qid", slug(F.col("chunk_id")).alias("_p"), "start_page", "end_page"), "qid").where(F.col("paper") == F.col("_p")).groupBy("qid", "nth").agg(F.bool_or(on_page(F.col("pages"), F.col("start_page"), F.col("end_page"))).alias("_on"))
    whole = each.select("qid", "nth").join(near, ["qid", "nth"], "left").groupBy("qid").agg(F.bool_and(F.coalesce("_on", F.lit(False))).alias("page_overlap"))
    return questions.select("qid").join(whole, "qid", "left").select("qid", F.coalesce("page_overlap", F.lit(False)).alias("page_overlap"))


def question_rows(hits: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """A row for each question: qid, qtype, paper, rank_found, page_overlap_top10, top5_context_chars, and the ids of
    its hits (qid, rank, chunk_id, text, start_page, end_page) in order."""
    own = hits.groupBy("qid").agg(F.sum(F.when(F.col("rank") <= k, F.length("text")).otherwise(0)).alias("chars"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"]).alias("ids"))
    papers = F.array_join(F.transform("evidence", lambda e: e["paper"]), "+")
    base = questions.select("qid", "qtype", papers.alias("paper")).join(ranks(hits, questions), "qid").join(page_overlap(hits, questions).withColumnRenamed("page_overlap", "page_overlap_top10"), "qid").join(own, "qid", "left")
    return base.select("qid", "qtype", "paper", "rank_found", "page_overlap_top10", F.coalesce("chars", F.lit(0)).cast("int").alias("top5_context_chars"), F.coalesce("ids", F.expr("cast(array() as array<string>)")).alias("retrieved_chunk_ids"))


def run_metrics(rows: DataFrame, latencies: DataFrame | None = None) -> DataFrame:
    """One row over question_rows(): recall at 1, 3, 5 and 10, MRR at 10, mean characters, counts of questions,
    hits and misses on the right page, and the latencies' (latency_ms) median and 95th percentile."""
    out = rows.agg(*(recall(k).alias(f"recall_at_{k}") for k in (1, 3, 5, 10)), mrr().alias("mrr_at_10"), F.coalesce(F.avg("top5_context_chars"), F.lit(0.0)).alias("mean_context_chars_at_5"), F.count("*").alias("n_questions"), F.count("rank_found").alias("n_hits_at_10"), F.count_if(F.col("rank_found").isNull() & F.col("page_overlap_top10")).alias("n_page_overlap_misses"))
    if latencies is None:
        return out.withColumns({"median_latency_ms": F.lit(None).cast("double"), "p95_latency_ms": F.lit(None).cast("double")})
    some = latencies.where("latency_ms is not null")
    at = percentile_at(some, "latency_ms", F.bround(0.95 * (F.col("n") - 1)))
    return out.crossJoin(F.broadcast(some.agg(F.percentile("latency_ms", 0.5).alias("median_latency_ms")))).crossJoin(F.broadcast(at.agg(F.max("latency_ms").alias("p95_latency_ms"))))


def percentile_at(rows: DataFrame, value: str, position: Column, by: str | None = None) -> DataFrame:
    """(by, value): the value at a 0-based position among a group's n, from counts of distinct values."""
    keys = [by] if by else []
    each = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys)
    run = each.withColumns({"upto": F.sum("c").over(w.orderBy(value)), "n": F.sum("c").over(w)})
    return run.where((position >= F.col("upto") - F.col("c")) & (position < F.col("upto"))).select(*keys, value)


def breakdown(rows: DataFrame) -> DataFrame:
    """recall_at_5 and counts by qtype and paper, with totals (nulls) of each."""
    return rows.rollup("qtype", "paper").agg(F.count("*").alias("n"), F.round(recall(5), 6).alias("recall_at_5"))


def compare_runs(runs: DataFrame) -> DataFrame:
    """Metrics by config_id of question rows with that column: a staged search is one grouping, not a loop."""
    return runs.groupBy("config_id").agg(*(F.round(recall(k), 6).alias(f"recall_at_{k}") for k in (1, 5)), F.round(mrr(), 6).alias("mrr_at_10"), F.count("*").alias("n_questions"))


def grid_rows(ranks_of: dict[tuple[str, str], DataFrame], cuts: tuple[int, ...]) -> DataFrame:
    """(strategy, retriever, k, qid, rank_found): ranks (qid, rank_found) of each (strategy, retriever), at each cut; one
    plan for all configurations. A rank beyond the cut is none."""
    out = None
    for (strategy, retriever), rows in ranks_of.items():
        part = rows.select(F.lit(strategy).alias("strategy"), F.lit(retriever).alias("retriever"), F.explode(F.array(*map(F.lit, cuts))).alias("k"), "qid", "rank_found")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("rank_found", F.when(F.col("rank_found") <= F.col("k"), F.col("rank_found")))


FACTORS = ["strategy", "retriever", "k"]


def grid(rows: DataFrame) -> DataFrame:
    """(strategy, retriever, k, n, recall, mrr) of grid_rows(): each configuration, each value of each factor over all
    others (the others null), and all; one aggregation over grouping sets."""
    sets = [FACTORS, *([f] for f in FACTORS), []]
    found = F.round(F.avg(F.when(F.col("rank_found").isNotNull(), 1.0).otherwise(0.0)), 6).alias("recall")
    mean = F.round(F.avg(F.coalesce(1.0 / F.col("rank_found"), F.lit(0.0))), 6).alias("mrr")
    return rows.groupingSets(sets, *FACTORS).agg(F.count("*").alias("n"), found, mean)


def staged_choice(table: DataFrame, start: dict[str, object], factors: list[str] | None = None) -> DataFrame:
    """(stage, strategy, retriever, k, recall, mrr, chosen): one factor after another takes its best value, the others as
    they were chosen or, yet to come, as ``start`` has them. Best: recall, then mrr, then the value's order.

    ``table`` is grid(): a row for each configuration comes to the driver. A start that isn't in it is an error.
    """
    cells = [r for r in table.collect() if all(r[f] is not None for f in FACTORS)]
    now, out = dict(start), []
    for stage, factor in enumerate(factors or FACTORS, 1):
        tried = sorted((r for r in cells if all(r[f] == now[f] for f in FACTORS if f != factor)), key=lambda r: (-r.recall, -r.mrr, r[factor]))
        if not tried:
            raise ValueError(f"no configuration like {now}")
        now[factor] = tried[0][factor]
        out += [(stage, r.strategy, r.retriever, r.k, r.recall, r.mrr, r is tried[0]) for r in tried]
    return table.sparkSession.createDataFrame(out, "stage int, strategy string, retriever string, k int, recall double, mrr double, chosen boolean")


def run(questions: DataFrame, retrieve, chunks: DataFrame, keys: list[str], rerank=None, candidates: int = 20, k: int = 10) -> DataFrame:
    """Question rows of a retriever (queries, k) over all answerable questions in one plan. ``chunks`` has keys,
    chunk_id, text, start_page and end_page; ``rerank`` (hits, queries, k) orders ``candidates`` hits anew."""
    asked = answerable(questions)
    queries = asked.select("qid", F.col("question").alias("text"))
    hits = retrieve(queries, candidates if rerank else k)
    hits = rerank(hits, queries, k) if rerank else hits
    return question_rows(hits.select("qid", *keys, "rank").join(chunks, keys), asked)
