"""Similar pairs and matching in rounds, against brute force and the sequential walk."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import matching, sampling
from lectern.plans import queries as Q

SF = "/root/testdata"


def brute_pairs(rows, cosine):
    ids, labels, x = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], float)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x = x / np.where(norm == 0, 1, norm)
    s = np.round(x @ x.T, 6)
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(s >= cosine), strict=True) if ids[i] < ids[j] and (labels[i] != labels[j] or labels[i] is None)}


@pytest.mark.parametrize(("sf", "cosine", "least"), [("sf0.01", 0.35, 1.0), ("sf0.1", 0.4, 0.999)])
def test_pairs_of_the_table_equal_brute_force(spark, sf, cosine, least):
    v = spark.read.parquet(f"{SF}/{sf}/embeddings.parquet")
    want = brute_pairs([tuple(r) for r in v.select("vec_id", "label", "embedding").collect()], cosine)
    got = [(r.a, r.b) for r in matching.similar_pairs(v, cosine).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= least * len(want) and len(want) > 50


def test_pairs_of_classes_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(30, 12))
    rows = [(i, int(i % 3), (base[i % 30] + (0.05 * rng.normal(size=12) if i >= 60 else 0)).tolist()) for i in range(150)]
    odd = [(900, 1, None), (901, 1, [float("nan")] * 12), (902, 1, [0.0] * 12), (903, 2, [1.0, 2.0]), (904, 1, [1.0, 2.0]), (905, None, [5e299, 1e300]), (906, None, [0.5, 1.0])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").withColumns({"code": F.lit("x"), "place": F.lit(1)})
    got = {(r.a, r.b): (r.members_a, r.members_b, r.score) for r in matching.similar_pairs(df, 0.9).collect()}
    # Copies of one label are one class under the smallest id.
    classes = {}
    for i, label, x in rows:
        classes.setdefault((label, tuple(x)), []).append(i)
    one = [(ids[0], label, list(x)) for (label, x), ids in classes.items()]
    assert {p for p in got if p[1] < 900} == brute_pairs(one, 0.9)
    members = {ids[0]: len(ids) for ids in classes.values()}
    assert all(v[:2] == (members[a], members[b]) for (a, b), v in got.items() if b < 900)
    assert {p for p in got if p[1] >= 900} == {(903, 904), (903, 905), (904, 905), (903, 906), (904, 906), (905, 906)}
    assert matching.similar_pairs(df.where("false"), 0.9).count() == 0
    assert {(r.a, r.b) for r in matching.similar_pairs(df.where("vec_id < 900"), 0.9, across=False).collect()} >= brute_pairs(one, 0.9)


def test_one_bucket_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK", 8)
    rng = np.random.default_rng(8)
    rows = [(i, i % 5, (np.ones(6) + 0.02 * rng.normal(size=6)).tolist()) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    got = [(r.a, r.b) for r in matching.similar_pairs(df, 0.9).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, 0.9)


def test_tables_grow_as_the_threshold_falls():
    for n in (500, 10**6, 10**9):
        chosen = [matching.tables_for(n, c) for c in (0.95, 0.8, 0.5)]
        for (bits, tables), c in zip(chosen, (0.95, 0.8, 0.5), strict=True):
            assert (1 - (1 - np.arccos(c) / np.pi) ** bits) ** tables <= matching.MISSED
        assert [t for _, t in chosen] == sorted(t for _, t in chosen)


def walk(pairs, most):
    used, lent, out = set(), Counter(), []
    for a, b, ga, gb, s in sorted(set(pairs), key=lambda p: (-p[4], p[0], p[1])):
        groups = frozenset((ga, gb))
        if a != b and a not in used and b not in used and lent[groups] < most:
            used |= {a, b}
            lent[groups] += 1
            out.append((a, b, ga, gb, s))
    return out


@pytest.mark.parametrize("most", [1, 3])
def test_thousand_random_tables_match_the_walk(spark, most):
    """Tables whose passages and groups are their own are walked as if each were alone."""
    rng, rows, want = random.Random(most), [], []
    for t in range(1000):
        n, groups = rng.randrange(2, 9), rng.randrange(1, 4)
        group = {i: None if rng.random() < 0.1 else t * 10 + rng.randrange(groups) for i in range(n)}
        group = {i: g if g is not None else t * 10 + 9 for i, g in group.items()}
        pairs = [(t * 100 + i, t * 100 + j, group[i], group[j], rng.randrange(4) / 4) for i, j in ((rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 18)))]
        rows += pairs
        want += walk(pairs, most)
    df = spark.createDataFrame(rows, "a long, b long, group_a int, group_b int, score double").repartition(6)
    got = [tuple(r) for r in matching.match_in_rounds(df, most).collect()]
    assert sorted(got) == sorted(want)


def test_matching_of_one_large_pair_of_groups_nulls_and_nothing(spark):
    rng = random.Random(2)
    rows = [(i, 10_000 + rng.randrange(400), 1, 2, rng.random()) for i in range(400) for _ in range(5)]
    df = spark.createDataFrame(rows, "a long, b long, group_a int, group_b int, score double")
    assert sorted(tuple(r) for r in matching.match_in_rounds(df, 50).collect()) == sorted(walk(rows, 50))
    odd = spark.createDataFrame([(1, None, 1, 2, 0.5), (1, 1, 1, 1, 0.9), (1, 2, None, None, 0.8), (3, 4, None, 1, None), (5, 6, None, 1, 0.1), (5, 6, None, 1, 0.1), (6, 5, 1, None, 0.3)], df.schema)
    assert sorted((r.a, r.b) for r in matching.match_in_rounds(odd).collect()) == [(1, 2), (6, 5)]
    assert matching.match_in_rounds(df.where("false")).count() == 0


def test_greedy_pairs_query_matches_the_walk(spark):
    sf = f"{SF}/sf0.1"
    pairs = [(r.a, r.b, r.group_a, r.group_b, r.score) for r in matching.similar_pairs(spark.read.parquet(f"{sf}/embeddings.parquet"), Q.PAIR_COSINE).collect()]
    assert sorted((r.a, r.b, r.score) for r in Q.queries()["greedy_pairs"](spark, sf).collect()) == sorted((a, b, s) for a, b, _, _, s in walk(pairs, 3))


def test_comparative_fill_takes_the_first_accepted(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(40), rng.randrange(40), rng.randrange(30), rng.random() < 0.6) for _ in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, rank int, accepted boolean")
    used = {3, 7, 20}
    want, seen = [], set(used)
    for a, b, rank, ok in sorted(set(rows), key=lambda p: (p[2], p[0], p[1])):
        if ok and a != b and a not in seen and b not in seen and len(want) < 10:
            seen |= {a, b}
            want.append((a, b, rank))
    got = sampling.fill_comparative(df, spark.createDataFrame([(u,) for u in used], "chunk_id int"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert sampling.fill_comparative(df.where("false"), spark.createDataFrame([], "chunk_id int")).count() == 0


def test_all_blocks_meet_where_tables_cost_more(spark, monkeypatch):
    v = spark.read.parquet(f"{SF}/sf0.01/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 9 > 0, F.col("label")))
    both = []
    monkeypatch.setattr(matching, "BLOCK", 64)
    monkeypatch.setattr(matching, "tables_for", lambda *_: (2, 60))
    for shipped in (2000, -2000):
        monkeypatch.setattr(matching, "SHIPPED", shipped)
        pairs = matching.similar_pairs(v, 0.35)
        both.append(sorted(tuple(r) for r in pairs.fillna(-1).collect()))
        assert ("CartesianProduct" in pairs._jdf.queryExecution().toString()) == (shipped > 0)
    assert both[0] == both[1] and len(both[0]) > 50


def test_batches_of_a_walk(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(rng.randrange(60), 100 + rng.randrange(60), rng.randrange(2), rng.randrange(2), rng.randrange(40) / 40) for _ in range(600)]
    df = spark.createDataFrame(rows, "a long, b long, group_a int, group_b int, score double")
    seen, whole = [], matching._rounds
    monkeypatch.setattr(matching, "_rounds", lambda live: seen.append(live.count()) or whole(live))
    monkeypatch.setattr(matching, "BATCH", 20)
    for most in (2, 50):
        assert sorted(tuple(r) for r in matching.match_in_rounds(df, most).collect()) == sorted(walk(rows, most))
    # The walk with small capacities ends before all pairs are drawn.
    assert seen[0] < 60 and len(seen) > 2 and sum(seen[:-1]) < 2 * len(set(rows))


def test_pairs_of_a_fill_are_made_once(spark, tmp_path):
    folder = str(tmp_path)

    def run(frames):
        import tempfile

        for f in frames:
            with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as note:
                note.write(str(len(f)))
            yield f

    pairs = spark.createDataFrame([(i, 100 + i, i / 7, True) for i in range(50)], "a int, b int, rank double, accepted boolean").mapInPandas(run, "a int, b int, rank double, accepted boolean")
    got = sampling.fill_comparative(pairs, spark.createDataFrame([(0,)], "chunk_id int")).collect()
    assert sorted(r.a for r in got) == list(range(1, 11))
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 50
