"""The core operators: worked cases, and every query with SQL against DuckDB."""

import hashlib
import json
import random
import re
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern import cli, registry, sql
from lectern.functions import text as T
from lectern.operators import chunking, encoding, evaluation, generation, judging, layout, matching, metrics, sampling
from lectern.plans import queries as Q
from lectern.sources import files, runs
from lectern.streaming.incremental import chunk_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).iterdir():
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def normal(df):
    plain = lambda x: None if pd.isna(x) else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return sorted(str([plain(x) for x in r]) for r in df[sorted(df.columns)].values.tolist())


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    got, want = Q.queries()[name](spark, SF).toPandas(), duck.sql(Q.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and normal(got) == normal(want)


@pytest.mark.parametrize(("n", "count"), [(0, 0), (1000, 1), (1001, 2), (1900, 2), (1901, 3)])
def test_fixed_chunk_counts(spark, n, count):
    df = spark.createDataFrame([(1, "x" * n), (2, None)], "doc_id int, text string")
    assert chunking.fixed_chunks(df).count() == count


def test_sections(spark):
    lines = ["intro text", "1. Introduction Part", "body", "METHODS", "Results", "found it", "Appendix"]
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "doc_id int, line_no int, line string")
    assert [(r.header, r.body) for r in chunking.sections(df).orderBy("section_no").collect()] == [("Preamble", "intro text"), ("1. Introduction Part", "body"), ("Results", "found it")]


def test_recursive_split():
    split = lambda t, n: [p for _, p in chunking.split_recursively(t, n)]
    assert split("\n\naaaa\n\nbb", 8) == ["aaaa\n\nbb"] and split("   ", 8) == [] and split("short", 8) == ["short"]
    assert split("aaa bbb. ccc ddd\neee\n\n" + "f" * 25 + "\n\nggg", 10) == ["aaa bbb", "ccc ddd", "eee", "f" * 10, "f" * 10, "f" * 5, "ggg"]
    assert split("aa bb cc dd", 5) == ["aa bb", "cc dd"] and split("x" * 2500, 1000) == ["x" * 1000, "x" * 1000, "x" * 500]
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(["ab", " ", "\n", "\n\n", ". ", "cdefgh"]) for _ in range(r.randint(0, 30)))
        pieces = chunking.split_recursively(text, 9)
        assert all(len(p) <= 9 and text[a : a + len(p)] == p for a, p in pieces)
        assert re.sub(r"[\s.]", "", text) == re.sub(r"[\s.]", "", "".join(p for _, p in pieces))
        assert all(a + len(p) <= b for (a, p), (b, _) in zip(pieces, pieces[1:]))


def test_merge_and_stitch():
    make = lambda *sizes: [{"start": 10 * k, "end": 10 * k + n, "text": chr(97 + k) * n, "section": None if k else "S"} for k, n in enumerate(sizes)]
    sizes = lambda *n: [len(p["text"]) for p in chunking.merge_tiny(make(*n))]
    assert sizes(2, 100, 2) == [106] and sizes(79, 100, 80) == [180, 80] and sizes(100, 79, 5) == [100, 85] and sizes(3) == [3] and sizes() == [] and sizes(1, 1, 1) == [5]
    merged = chunking.merge_tiny(make(2, 100, 2))[0]
    assert (merged["start"], merged["end"], merged["section"]) == (0, 110, "S")
    assert chunking.merge_tiny([{"start": 0, "end": 90, "text": "a" * 70 + " " * 20, "section": None}] * 2)[0]["text"] == "a" * 70 + "\n" + "a" * 70
    assert chunking.stitch([(0, "one two"), (8, "three")], 4) == [(0, 7, "one two"), (4, 13, "two three")] and chunking.stitch([(0, "ab"), (2, "cd")], 0) == [(0, 2, "ab"), (2, 4, "cd")]


def test_stitching_and_merging_rows_equal_the_texts_forms(spark):
    """The window forms against the sequential ones, on random pieces with blanks, empty texts and runs of tiny chunks."""
    r = random.Random(5)
    rows, stitched, merged = [], [], []
    for d in range(120):
        at, pieces = 0, []
        for i in range(r.randrange(1, 14)):
            t = "".join(r.choice("ab  \n") for _ in range(r.choice([0, 1, 3, 8, 20])))
            pieces.append({"start": at, "end": at + len(t), "text": t, "section": r.choice([None, "", f"s{i}"])})
            at += len(t) + r.randrange(3)
        rows += [(d, i, p["start"], p["end"], p["text"], p["section"], i, i + 1) for i, p in enumerate(pieces)]
        stitched += [(d, i, *x) for i, x in enumerate(chunking.stitch([(p["start"], p["text"]) for p in pieces], 5))]
        merged += [(d, i, p["start"], p["end"], p["text"], p["section"]) for i, p in enumerate(chunking.merge_tiny(pieces, 7))]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, char_start int, char_end int, text string, section string, start_page int, end_page int").repartition(5)
    cols = ["doc_id", "chunk_index", "char_start", "char_end", "text"]
    assert sorted(tuple(x) for x in chunking.stitch_rows(df, 5, ["doc_id"]).select(*cols).collect()) == stitched
    assert chunking.stitch_rows(df, 0, ["doc_id"]).select(*cols[:3], "text").exceptAll(df.select(*cols[:3], "text")).count() == 0
    got = sorted(chunking.merge_tiny_rows(df, 7).collect(), key=lambda x: (x.doc_id, x.chunk_index))
    assert [tuple(x)[:6] for x in got] == merged
    assert all(x.start_page < x.end_page for x in got)
    assert chunking.merge_tiny_rows(df.where("false")).count() == 0


def test_pages_of_section_aware_chunks(spark):
    lines = [(1, k, k // 4 + 1, "RESULTS" if k % 5 == 2 else "word " * (k % 7)) for k in range(40)] + [(2, 0, 9, "")]
    df = spark.createDataFrame(lines, "doc_id int, line_no int, page_number int, line string")
    text = "\n".join(x[3] for x in lines[:40])
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "no lines known")], "doc_id int, text string")
    page = [p for _, _, p, line in lines[:40] for _ in range(len(line) + 1)]
    got = chunking.page_ranges(chunking.section_aware_chunks(docs, size=90, overlap=10), chunking.line_spans(df)).collect()
    assert len(got) >= 6 and {x.doc_id for x in got} == {1, 3}
    for x in got:
        assert (x.start_page, x.end_page) == ((page[x.char_start], page[max(x.char_start, x.char_end - 1)]) if x.doc_id == 1 else (None, None))


def test_section_aware_chunks(spark):
    body = "A sentence of some words here. " * 60
    text = "intro " * 20 + "\n1. Introduction Part\n" + body + "\nMETHODS\nResults\n" + "found it " * 20 + "\nDiscussion\n\nConclusion\nshort end\nAppendix"
    got = chunking.section_aware_chunks(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert [r.section for r in got if r.section != "1. Introduction Part"] == ["Preamble", "Results", "Discussion"] and got[-1].text == "Discussion\nConclusion\nshort end"
    own = [r for r in got if r.section == "1. Introduction Part"]
    assert len(own) == 2 and own[0].text.startswith("1. Introduction Part\nIntroduction Part A sentence") and all(len(r.text) <= 1130 for r in own)
    assert [r.chunk_index for r in got] == list(range(len(got))) and text[got[0].char_start :].startswith("intro") and text[own[0].char_start :].startswith("A sentence")
    few = chunking.STRATEGIES["section_aware_600"](spark.createDataFrame([(1, text)], "doc_id long, text string")).count()
    assert few > len(got)


def test_files_and_runs(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"Results\n{'word ' * 300}") for k in range(3)], "doc_id long, text string")
    manifest = files.build_corpus(docs, str(tmp_path / "chunks"))
    assert set(manifest["strategies"]) == {"fixed_size", "recursive", "section_aware"} and not manifest["chunk_id_collisions"]
    records = runs.read_chunks(spark, str(tmp_path / "chunks"))
    assert records.count() == sum(x["num_chunks"] for x in manifest["strategies"].values())
    assert files.read_content_chunks(spark, str(tmp_path / "chunks")).count() == records.count()
    made = files.build_collections(encoding.token_stats(records), {"hash64": encoding.encode_passages}, str(tmp_path / "vectors"))
    assert made == {"hash64": records.count()} and len(files.read_collection(spark, str(tmp_path / "vectors")).first().embedding) == 64
    lines = ['{"qid": "q0001", "question": "a?", "qtype": "factual", "paper": "p", "gold_pages": [1, 2], "gold_span": "s", "gold_answer": "x", "answerable": true, "reviewed_by_human": false, "source_chunk_id": "p::f::0001"}', "", '{"qid": "q0002", "question": "b?", "qtype": "comparative", "paper": ["p", "r"], "gold_pages": [[1], [2, 3]], "gold_span": ["s", "t"], "gold_answer": "y", "answerable": true, "source_chunk_id": ["c", "d"]}', '{"qid": "q0003", "question": "c?", "qtype": "unanswerable", "paper": null, "gold_span": null, "answerable": false}']
    (tmp_path / "gold.jsonl").write_text("\n".join(lines))
    gold = {r.qid: r for r in files.read_questions(spark, str(tmp_path / "gold.jsonl")).collect()}
    assert [[(e.paper, e.span, e.pages) for e in gold[q].evidence] for q in sorted(gold)] == [[("p", "s", [1, 2])], [("p", "s", [1]), ("r", "t", [2, 3])], []]
    assert [gold[q].answerable for q in sorted(gold)] == [True, True, False]
    twice = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "qid string, nth int, v string")
    assert {r.qid: r.v for r in files.by_qid(twice, "nth").collect()} == {"a": "y", "b": "z"}
    rows = spark.createDataFrame([("q1", 2, True, ["a", "b"]), ("q2", None, False, [])], "qid string, rank_found int, page_overlap_top10 boolean, retrieved_chunk_ids array<string>")
    files.write_csv_run(rows, {"k": 5}, str(tmp_path / "run"))
    back = {r.qid: r for r in runs.read_results(spark, str(tmp_path / "run/results")).collect()}
    assert back["q1"].rank_found == 2 and back["q1"].page_overlap_top10 and back["q1"].retrieved_chunk_ids == ["a", "b"] and back["q2"].rank_found is None
    typed = files.typed_answers(spark.createDataFrame([("q", "", "True"), ("r", "1.5", "False")], "qid string, top_rerank_score string, model_abstained string")).collect()
    assert [tuple(r)[1:] for r in typed] == [(None, True), (1.5, False)]
    contexts = spark.createDataFrame([("q", ["c"], [[1, 2]], [0.5], ["t"])], files.CONTEXTS)
    files.write_contexts(contexts, str(tmp_path / "contexts"))
    assert files.read_contexts(spark, str(tmp_path / "contexts")).collect() == contexts.collect()
    assert files.read_baseline(str(tmp_path / "b.json")) is None and files.write_baseline(str(tmp_path / "b.json"), {}, 0.8, None, "first")["recall_at_5"] == 0.8
    assert cli.gate(files.read_baseline(str(tmp_path / "b.json")), 0.78, None)[0] == 0 and cli.gate(files.read_baseline(str(tmp_path / "b.json")), 0.77, None)[0] == 1 and cli.gate(None, 1, None)[0] == 1
    with pytest.raises(ValueError):
        files.write_baseline(str(tmp_path / "b.json"), {}, 0.8, None, " ")
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, str(tmp_path / "*.nothing"))
    assert files.file_hashes(spark, str(tmp_path / "gold.jsonl")).first().sha256 == hashlib.sha256((tmp_path / "gold.jsonl").read_bytes()).hexdigest()
    assert files.fingerprint(records).first() == files.fingerprint(records.repartition(3)).first() and len(files.provenance(str(tmp_path / "gold.jsonl"))["code_version"]) == 12
    parse = lambda data: [(1, 0, 0.0, 0.0, 1.0, 1.0, data.decode()[:5], 0, 10.0), (1, 1, 0.0, 0.0, 1.0, 1.0, " ", 0, 10.0), (1, 2, 0.0, 0.0, 1.0, 1.0, "i", 1, 10.0)]
    assert [r.block_no for r in files.scan_documents(spark, str(tmp_path / "gold.jsonl"), parse).collect()] == [0]
    scores = spark.createDataFrame([("r", "m", 0.5, 1, 2), ("r", "n", None, 0, 2)], "run_id string, metric string, mean double, n_scored long, n_total long")
    assert files.score_report(scores).splitlines()[-1] == "| r | 0.5000 (n=1/2) | - |"


def test_page_overlap_cases(spark):
    q = spark.createDataFrame([(1, [("p", "s", [3, 70], None)]), (2, [("p", "s", None, None)]), (3, [("p", "s", [3], None), ("r", "t", [5], None)]), (4, [])], f"qid int, evidence {evaluation.EVIDENCE}")
    h = spark.createDataFrame([(1, "p::f::0001", 78, 68), (2, "p::f::0001", 1, 9), (3, "p::f::0001", 3, 3), (3, "r::f::0001", None, 5), (4, "p::f::0001", 1, 9)], "qid int, chunk_id string, start_page int, end_page int")
    assert {r.qid: r.page_overlap for r in evaluation.page_overlap(h, q).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_generation_and_judges(spark):
    hits = spark.createDataFrame([(1, 1, "p::f::0001", "The sky is blue. Grass is green.", 1, 2, 0.9), (1, 2, "r::f::0002", "Nothing.", 3, 3, 0.5)], "qid int, rank int, chunk_id string, text string, start_page int, end_page int, score double")
    gold = spark.createDataFrame([(1, "What is green?", "factual", True, "green", [("p", "Grass", [1], None)]), (2, "Who?", "unanswerable", False, None, [])], f"qid int, question string, qtype string, answerable boolean, gold_answer string, evidence {evaluation.EVIDENCE}")
    rows, contexts = generation.run(gold, hits)
    got = {r.qid: r for r in rows.collect()}
    assert got[1].final_text == "Grass is green. (p, p. 1-2)" and got[1].gold_answer_found and got[1].cited_numbers == "1" and got[1].invalid_citations == ""
    assert got[2].model_abstained and got[2].gold_answer_found is None and got[2].n_context_blocks == 0 and got[2].top_rerank_score is None
    record = judging.judge_records(gold, rows, contexts)
    assert record.count() == 1 and {r.metric for r in judging.score_by_overlap(record).collect()} == set(judging.METRICS)

    def judge(r):
        if r["qid"] == 1:
            raise ValueError
        return 1.0

    scored = judging.score_with(record.union(record.withColumn("qid", F.lit(5))), judge, "m")
    assert judging.aggregate_scores(scored).first()[1:] == (1.0, 1, 2)
    was = rows.select("qid", (F.col("top_rerank_score") + 1).alias("top_rerank_score"), "model_abstained")
    with pytest.raises(ValueError):
        judging.rebuild_contexts(generation.context_blocks(hits), was, lambda d: None)
    kept = []
    judging.rebuild_contexts(generation.context_blocks(hits), rows.select("qid", "top_rerank_score", "model_abstained"), kept.append)
    assert len(kept) == 1


def test_sampling(spark):
    pairs = spark.createDataFrame([(1, 5, "x", "y", 0.9), (1, 6, "x", "y", 0.8), (2, 6, "x", "y", 0.8), (3, 7, "x", "y", 0.7), (4, 8, "y", "x", 0.6), (2, 9, "x", "z", 0.5), (10, 9, "x", "z", 0.4)], "a int, b int, group_a string, group_b string, score double")
    assert sorted((r.a, r.b) for r in matching.match_in_rounds(pairs).collect()) == [(1, 5), (2, 6), (3, 7), (10, 9)]
    pool = spark.createDataFrame([(k, "s", f"c{i}", i, i != 1) for k in ("one", "two") for i in range(5)], "kind string, source string, chunk_id string, rank int, accepted boolean")
    quota = spark.createDataFrame([("s", 2)], "source string, quota int")
    assert sorted((r.kind, r.chunk_id) for r in sampling.fill_in_order(pool, [("one", quota), ("two", quota)], "source").collect()) == [("one", "c0"), ("one", "c2"), ("two", "c3"), ("two", "c4")]
    calls = []
    assert sampling.call_with_retry(lambda: calls.append(1) or 1 / 0, 3, 1.5, lambda s: calls.append(s)) is None and calls == [1, 1.5, 1, 3.0, 1] and sampling.call_with_retry(lambda: "x") == "x"
    two = lambda a, b: json.dumps({"question": "q", "gold_span_a": a, "gold_span_b": b, "gold_answer": "g"})
    d = spark.createDataFrame([(two("one", "two"),), (two("no", "two"),), (two("one", "no"),)], "d string")
    assert [r[0] for r in d.select(sampling.comparative_reason(F.col("d"), F.lit("One text"), F.lit("text two"))).collect()] == [None, "span_a_not_verbatim", "span_b_not_verbatim"]
    p = spark.createDataFrame([("p::f::0001", "a fine Text", 2, 1, '{"question": " q ", "gold_span": "fine text", "gold_answer": "a"}'), ("p::f::0002", "a", 1, 1, None)], "chunk_id string, text string, start_page int, end_page int, draft string")
    made = sampling.drafted(p, "factual").collect()
    assert len(made) == 1 and made[0].question == "q" and made[0].evidence[0].pages == [1, 2]


def test_command_line(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"text number{k} of some words {'filler ' * 30}") for k in range(5)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    (tmp_path / "gold.jsonl").write_text("\n".join(json.dumps({"qid": f"q{k:04d}", "question": f"number{k}", "qtype": "factual", "paper": str(k), "gold_pages": [1], "gold_span": f"number{k}", "gold_answer": "x", "answerable": True}) for k in range(5)))
    where = [str(tmp_path / "docs"), str(tmp_path / "gold.jsonl")]
    assert cli.main(["retrieve", *where, str(tmp_path / "out"), "--strategy", "fixed_size", "--retriever", "hybrid"], spark) == 0
    base = ["--strategy", "fixed_size", "--baseline", str(tmp_path / "base.json")]
    assert cli.main(["gate", *where, *base, "--skip-faithfulness"], spark) == 1
    assert cli.main(["gate", *where, *base, "--update-baseline", "first"], spark) == 0
    assert 0 < files.read_baseline(str(tmp_path / "base.json"))["faithfulness"] <= 1
    assert cli.main(["gate", *where, *base], spark) == 0
    assert cli.gate({"recall_at_5": 1.0, "faithfulness": 0.9}, 1.0, 0.8) == (1, "regression: faithfulness 0.9000 -> 0.8000")
    assert cli.gate({"recall_at_5": 1.0, "faithfulness": 0.9}, 1.0, None) == (0, "no regression (faithfulness not compared)")


def test_command_line_pages_rerank_generation_and_ids(spark, tmp_path):
    """Ids that share their digits stay apart; lines give pages; a run's four tables are written."""
    lines = [(10**13 + d, k, k // 3 + 1, f"line {k} of document{d} " + "filler " * 12) for d in range(4) for k in range(9)]
    spark.createDataFrame(lines, "doc_id long, line_no int, page_number int, line string").write.parquet(str(tmp_path / "lines"))
    docs = {d: "\n".join(x[3] for x in lines if x[0] == d) for d in {x[0] for x in lines}}
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    asked = [{"qid": f"{letter}1", "question": f"line 7 of document{d}", "qtype": "factual", "paper": str(10**13 + d), "gold_pages": [3], "gold_span": f"line 7 of document{d}", "gold_answer": f"document{d}", "answerable": True} for d, letter in enumerate("abcd")]
    asked.append({"qid": "e1", "question": "zebra crossing", "qtype": "none", "answerable": False})
    (tmp_path / "gold.jsonl").write_text("\n".join(map(json.dumps, asked)))
    where = [str(tmp_path / "docs"), str(tmp_path / "gold.jsonl"), str(tmp_path / "out"), "--strategy", "fixed_size", "--lines", str(tmp_path / "lines")]
    assert cli.main(["retrieve", *where, "--rerank", "--candidate-k", "20"], spark) == 0
    rows = spark.read.option("header", True).csv(str(next((tmp_path / "out").iterdir()) / "results"))
    got = {r.qid: r for r in rows.collect()}
    assert got.keys() == {"a1", "b1", "c1", "d1"} and all(r.rank_found and r.page_overlap_top10 == "True" for r in got.values())
    assert cli.main(["generate", *where, "--retriever", "hybrid"], spark) == 0
    made = next(p for p in (tmp_path / "out").iterdir() if (p / "tau_sweep").exists())
    said = files.typed_answers(spark.read.options(header=True, multiLine=True, escape=chr(34)).csv(str(made / "results")))
    assert {r.qid for r in said.collect()} == {"a1", "b1", "c1", "d1", "e1"}
    assert files.read_contexts(spark, str(made / "contexts")).count() >= 4


def test_registries_and_functions_by_name(spark):
    assert chunking.STRATEGIES["fixed_size"] is chunking.fixed_chunks
    with pytest.raises(ValueError, match="no strategy nothing"):
        chunking.STRATEGIES["nothing"]
    own = registry.Registry("thing", {"a": len})
    assert own.register("b")(max) is max and own["b"] is max
    with pytest.raises(ValueError, match="already"):
        own.register("a", min)
    sql.install(spark)
    sql.install(spark)  # anew
    docs = spark.createDataFrame([(1, "ab " * 40), (2, None), (3, ""), (4, " x\ny ")], "doc_id int, text string").withColumn("chunk_index", F.lit("z"))
    sql.views(spark, {"some_documents": docs})
    got = spark.sql("SELECT doc_id, c.* FROM some_documents, LATERAL chunk(text, 50, 7) c")
    want = chunking.fixed_chunks(docs, 50, 7)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r) for r in spark.sql("SELECT doc_id, t.* FROM some_documents, LATERAL terms(text) t").collect()} == {(1, "ab", 40), (4, "x", 1), (4, "y", 1)}
    assert [tuple(r) for r in spark.sql("SELECT l.* FROM some_documents, LATERAL text_lines(text) l WHERE doc_id = 4 ORDER BY 1").collect()] == [(0, " x"), (1, "y ")]
    for line in ("RESULTS", " 2.1 Second Part", "3 lower case", "", "x" * 90):
        r = spark.createDataFrame([(line,)], "l string").select(T.is_header(F.col("l")).alias("a"), T.content_hash(F.col("l")).alias("b"), F.expr("is_header_line(l)").alias("c"), F.expr("content_hash(l)").alias("d")).first()
        assert (r.a, r.b) == (r.c, r.d)


def test_layout_orders_columns_in_bands(spark):
    b = [(1, 1, k, *g, f"b{k}", 100.0) for k, g in enumerate([(0.0, 50.0, 90.0, 60.0), (55.0, 10.0, 95.0, 20.0), (5.0, 12.0, 45.0, 30.0), (5.0, 70.0, 45.0, 80.0), (50.0, 65.0, 90.0, 70.0)])]
    df = spark.createDataFrame(b, "doc int, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, page_width double")
    assert [r.block_no for r in layout.reading_order(df).orderBy("ord").collect()] == [2, 1, 0, 3, 4]
    assert layout.pages(layout.reading_order(df)).first().text == "b2\nb1\nb0\nb3\nb4"


def test_text_scalars(spark):
    row = spark.range(1).select(T.looks_numerical(F.lit("[12, 13] none")).alias("a"), T.looks_numerical(F.lit("5 %")).alias("b"), T.is_non_content(F.lit(" References ")).alias("c"), T.is_header(F.lit("x" * 81)).alias("d"), T.span_form(T.nfkc(F.lit("ﬁne soft­ly"))).alias("e")).first()
    assert tuple(row) == (False, True, True, False, "fine softly")


def test_metrics_on_worked_ranks(spark):
    df = spark.createDataFrame([(1,), (3,), (None,), (7,), (2,)], "rank_found int")
    r = df.agg(*metrics.summary()).first()
    assert (r.recall_at_1, r.recall_at_3, r.recall_at_10) == (0.2, 0.6, 0.8) and r.mrr_at_10 == round((1 + 1 / 3 + 1 / 7 + 1 / 2) / 5, 6)
    assert df.limit(0).agg(metrics.recall(5).alias("r")).first().r == 0.0
    e = spark.createDataFrame([(1, 1), (1, 3), (2, 1), (2, None)], "qid int, rank int")
    assert {r.qid: r.rank_found for r in metrics.all_evidence(e).collect()} == {1: 3, 2: None}


def test_regression_boundary(spark):
    make = lambda r, f: spark.createDataFrame([(r, f)], "recall_at_5 double, faithfulness double")
    passed = lambda r, f: metrics.regression(make(0.8, 0.9), make(r, f)).first().passed
    assert passed(0.78, None) and not passed(0.779, None) and not passed(0.9, 0.84)


def test_aggregates_of_recorded_results(spark, tmp_path):
    rows = ["qid,qtype,paper,rank_found,page_overlap_top10,top5_context_chars,retrieved_chunk_ids", 'q1,factual,p,1,True,500,a|b', 'q2,factual,"p, q",,True,300,c', "q3,method,p,7,False,100,", "q4,method,p,,False,100,d"]
    (tmp_path / "results.csv").write_text("\n".join(rows))
    read = runs.read_results(spark, str(tmp_path / "results.csv"))
    got = evaluation.run_metrics(read, spark.createDataFrame([(float(k),) for k in range(73)], "latency_ms double")).first()
    assert (got.recall_at_1, got.recall_at_5, got.recall_at_10, got.mean_context_chars_at_5) == (0.25, 0.25, 0.5, 250.0) and abs(got.mrr_at_10 - (1 + 1 / 7) / 4) < 1e-12
    assert (got.n_questions, got.n_hits_at_10, got.n_page_overlap_misses, got.median_latency_ms, got.p95_latency_ms) == (4, 2, 1, 36.0, 68.0)
    assert {r.config_id: r.recall_at_1 for r in evaluation.compare_runs(read.withColumn("config_id", F.lit("x"))).collect()} == {"x": 0.25}


def test_run_sink_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a" * 1500)], "doc_id int, text string")
    runs.write_run(df, df.limit(1), str(tmp_path / "runs"), runs.run_id("fixed", "hash", "bm25"))
    assert spark.read.parquet(str(tmp_path / "runs/results")).first().run_id == "fixed__bm25"
    df.write.parquet(str(tmp_path / "in"))
    chunk_stream(spark, str(tmp_path / "in"), "doc_id int, text string", str(tmp_path / "out"), str(tmp_path / "mark")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_spans_match_in_normal_form_and_ascii_stays_in_the_jvm(spark, monkeypatch):
    real = T.nfkc

    @F.pandas_udf("string")
    def only_odd(x: pd.Series) -> pd.Series:
        import unicodedata

        assert not any(s.isascii() for s in x)
        return x.map(lambda s: unicodedata.normalize("NFKC", s))

    monkeypatch.setattr(T, "nfkc", only_odd)
    hits = spark.createDataFrame([(1, 1, "nothing"), (1, 2, "The ﬁnal  co\u00adef\u00adﬁcient"), (2, 1, "PLAIN text"), (3, 1, None)], "qid int, rank int, text string")
    normal = T.with_span_form(hits)
    assert {r.norm_text for r in normal.collect()} == {"nothing", "the final coefficient", "plain text", None}
    ev = "array<struct<paper:string,span:string,pages:array<int>,source_chunk_id:string>>"
    asked = spark.createDataFrame([(1, [("p", "final coeﬃcient", [], None)]), (2, [("p", "plain", [], None)]), (3, [("p", "x", [], None)])], f"qid int, evidence {ev}")
    assert {r.qid: r.rank_found for r in evaluation.ranks(normal, asked).collect()} == {1: 2, 2: 1, 3: None}
    assert {r.qid: r.rank_found for r in evaluation.ranks(hits, asked).collect()} == {1: None, 2: 1, 3: None}
    spans = T.with_span_form(spark.createDataFrame([(1, "FINAL coef\u00adﬁcient")], "qid int, span string"), "span", "norm_span")
    assert metrics.first_ranks(normal, spans).first().rank_found == 2
    monkeypatch.setattr(T, "nfkc", real)


def test_staged_choice_fixes_one_factor_after_another(spark):
    ranks = lambda *r: spark.createDataFrame(list(enumerate(r)), "qid int, rank_found int")
    rows = evaluation.grid_rows({("a", "x"): ranks(1, None, None), ("a", "y"): ranks(1, 2, 3), ("b", "x"): ranks(1, 4, None), ("b", "y"): ranks(9, 9, None)}, (5, 10))
    table = evaluation.grid(rows)
    assert table.count() == 8 + 2 + 2 + 2 + 1 and table.where("strategy is null and retriever is null and k is null").first().n == 24
    got = [tuple(r) for r in evaluation.staged_choice(table, {"strategy": "a", "retriever": "x", "k": 5}).where("chosen").orderBy("stage").collect()]
    assert [r[:4] for r in got] == [(1, "b", "x", 5), (2, "b", "x", 5), (3, "b", "x", 5)]
    with pytest.raises(ValueError):
        evaluation.staged_choice(table, {"strategy": "c", "retriever": "z", "k": 5})


def test_runs_are_judged_together_as_alone(spark):
    q = spark.createDataFrame([(k, f"what is item{k}", "factual", True, f"item{k}", [("p", "x", [1], None)]) for k in range(6)], "qid int, question string, qtype string, answerable boolean, gold_answer string, evidence array<struct<paper:string,span:string,pages:array<int>,source_chunk_id:string>>")
    hits = spark.createDataFrame([(k, r, f"d{k}::f::{r:04d}", f"Here item{k} is block {r}. More words.", 1, 1, 1.0 / r) for k in range(6) for r in range(1, 4)], "qid int, rank int, chunk_id string, text string, start_page int, end_page int, score double")
    runs_ = {f"k{k}": generation.run(q, hits, k=k) for k in (1, 3)}
    got = {(r.config, r.qid, r.metric): r.score for r in judging.judge_runs(runs_, q).collect()}
    want = {(name, r.qid, r.metric): r.score for name, (rows, contexts) in runs_.items() for r in judging.score_by_overlap(judging.judge_records(q, rows, contexts)).collect()}
    assert got == want and len(got) > 20
