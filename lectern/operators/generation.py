"""Prompts, answers with citations, abstention, and what is recorded of them.

A generator is a function from rows (qid, question, blocks) to (qid, raw_text, latency_ms); ``extractive`` is an
offline stand-in. Citations are block numbers in brackets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import slug, span_form, tokens
from lectern.registry import Registry

#: Fixed value: the answer that abstains.
SENTINEL = "INSUFFICIENT_EVIDENCE"
CITATION = r"\[(\d+)\]"


def context_blocks(hits: DataFrame, k: int = 5) -> DataFrame:
    """(qid, blocks): the first ``k`` hits in order as (number, chunk_id, paper, start_page, end_page, text, score)."""
    paper = F.coalesce(slug(F.col("chunk_id")), F.col("chunk_id"))
    block = F.struct(F.col("rank").alias("number"), "chunk_id", paper.alias("paper"), "start_page", "end_page", "text", F.col("score").alias("score"))
    return hits.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(block)).alias("blocks"))


def context_record(blocks: DataFrame) -> DataFrame:
    """(qid, context_chunk_ids, context_pages, context_scores, context_texts) of blocks."""
    each = lambda f: F.transform("blocks", f)
    return blocks.select("qid", each(lambda b: b["chunk_id"]).alias("context_chunk_ids"), each(lambda b: F.array(b["start_page"], b["end_page"])).alias("context_pages"), each(lambda b: b["score"]).alias("context_scores"), each(lambda b: b["text"]).alias("context_texts"))


def build_prompt(question: Column, blocks: Column) -> Column:
    """The numbered blocks with their papers and pages, then the question."""
    line = lambda b: F.format_string("[%d] %s, pages %s-%s\n%s", b["number"], b["paper"], b["start_page"].cast("string"), b["end_page"].cast("string"), b["text"])
    return F.concat(F.array_join(F.transform(blocks, line), "\n\n"), F.lit("\n\nQuestion: "), question)


def is_abstained(raw: Column) -> Column:
    return F.coalesce(F.trim(raw) == SENTINEL, F.lit(False))


def cited_numbers(raw: Column) -> Column:
    """Distinct numbers cited, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(raw, F.lit(CITATION), F.lit(1)), lambda x: x.cast("int"))))


def invalid_citations(raw: Column, blocks: Column) -> Column:
    return F.array_except(cited_numbers(raw), F.transform(blocks, lambda b: b["number"].cast("int")))


def substitute_citations(raw: Column, blocks: Column) -> Column:
    """Numbers in brackets as paper and pages; those of no block stay."""
    place = lambda b: F.concat(F.lit("("), b["paper"], F.lit(", p. "), b["start_page"].cast("string"), F.when(b["end_page"] != b["start_page"], F.concat(F.lit("-"), b["end_page"].cast("string"))).otherwise(F.lit("")), F.lit(")"))
    return F.aggregate(blocks, raw, lambda t, b: F.replace(t, F.concat(F.lit("["), b["number"].cast("string"), F.lit("]")), place(b)))


def top_score(blocks: Column) -> Column:
    """The first block's score; null without blocks."""
    return F.get(blocks, F.lit(0))["score"]


def extractive(asked: DataFrame, least: float = 0.2) -> DataFrame:
    """(qid, raw_text): of asked (qid, question, blocks) the first block's sentence that shares most of the question's
    terms, cited, or the sentinel where it shares less than ``least`` of them. A stand-in for a model."""
    terms = F.array_distinct(tokens(F.col("question")))
    sentences = F.split(F.coalesce(F.get("blocks", F.lit(0))["text"], F.lit("")), r"(?<=[.!?])\s+")
    scored = F.transform(sentences, lambda s, i: F.struct((F.size(F.array_intersect(tokens(s), terms)) / F.greatest(F.size(terms), F.lit(1))).alias("share"), (-i).alias("order"), s.alias("s")))
    best = F.array_max(scored)
    return asked.select("qid", F.when(best["share"] >= least, F.concat(best["s"], F.lit(" [1]"))).otherwise(F.lit(SENTINEL)).alias("raw_text"))


#: Generators by name: each takes rows (qid, question, blocks) and gives (qid, raw_text[, latency_ms]).
GENERATORS = Registry("generator", {"extractive": extractive})


def answer_rows(questions: DataFrame, answers: DataFrame, blocks: DataFrame) -> DataFrame:
    """A row for each question with an answer (qid, raw_text, latency_ms) over its blocks (qid, blocks).

    gold_answer_found says whether the gold answer stands in the final text; null for questions without answer or
    gold answer, and for answers that abstain.
    """
    rows = questions.join(answers, "qid").join(blocks, "qid", "left")
    away, final = is_abstained(F.col("raw_text")), F.coalesce(substitute_citations(F.col("raw_text"), F.col("blocks")), F.col("raw_text"))
    joined = lambda x: F.coalesce(F.array_join(x, "|"), F.lit(""))
    judged = F.col("answerable") & ~away & (F.coalesce("gold_answer", F.lit("")) != "")
    rows = rows.withColumns({"final_text": final, "model_abstained": away})
    cited = F.when(away, F.expr("cast(array() as array<int>)")).otherwise(cited_numbers(F.col("raw_text")))
    wrong = F.when(away, F.expr("cast(array() as array<int>)")).when(F.col("blocks").isNull(), cited).otherwise(invalid_citations(F.col("raw_text"), F.col("blocks")))
    return rows.select("qid", "qtype", F.array_join(F.transform("evidence", lambda e: e["paper"]), "+").alias("paper"), "answerable", F.greatest(F.size("blocks"), F.lit(0)).alias("n_context_blocks"), "model_abstained", top_score(F.col("blocks")).alias("top_rerank_score"), joined(cited).alias("cited_numbers"), joined(wrong).alias("invalid_citations"), F.when(judged, span_form(F.col("final_text")).contains(span_form(F.col("gold_answer")))).alias("gold_answer_found"), "raw_text", "final_text", "latency_ms")


def diagnostics(rows: DataFrame) -> DataFrame:
    """One row: questions, abstentions, answers, answers without and with wrong citations, median latency."""
    says = ~F.col("model_abstained")
    return rows.agg(F.count("*").alias("n_questions_total"), F.count_if("model_abstained").alias("n_model_abstained"), F.count_if(says).alias("n_non_abstained_answers"), F.count_if(says & (F.col("cited_numbers") == "")).alias("n_non_abstained_with_no_citations"), F.count_if(says & (F.col("invalid_citations") != "")).alias("n_non_abstained_with_invalid_citation"), F.percentile("latency_ms", 0.5).alias("median_latency_ms"))


def run(questions: DataFrame, hits: DataFrame, generate=extractive, k: int = 5) -> tuple[DataFrame, DataFrame]:
    """Answer rows and context records of all questions, answerable or not, in one plan."""
    blocks = context_blocks(hits, k)
    asked = questions.select("qid", "question").join(blocks, "qid", "left")
    answers = generate(asked)
    answers = answers if "latency_ms" in answers.columns else answers.withColumn("latency_ms", F.lit(None).cast("double"))
    return answer_rows(questions, answers, blocks), context_record(blocks)
