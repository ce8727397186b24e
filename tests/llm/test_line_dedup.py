"""Line dedup (4) against the rule written plainly, and what it promises: all that goes in one place stands in another."""

import random
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import line_dedup, registry

SF = "/root/testdata/sf0.001"


def cut_lines(text):
    return (text or "").encode().split(b"\n")


def brute(docs):
    """{(id, text): removed lines} of docs, a set of (id, text); ids aren't null."""
    order = sorted(docs, key=lambda d: d[0])
    lines = {d: cut_lines(d[1]) for d in order}
    cut = {d: line_dedup.chunks(x) for d, x in lines.items()}
    groups = defaultdict(list)
    for d in order:
        for n, (a, b) in enumerate(cut[d]):
            if b - a > 1:
                groups[tuple(lines[d][a:b])].append((d, n))
    keeper = {x: v[0] for v in groups.values() if len(v) > 1 for x in v}
    gone_chunks = {x for x, k in keeper.items() if x != k}
    gone, runs = defaultdict(set), []
    for d, n in gone_chunks:
        k, m = keeper[d, n]
        a, b = cut[d][n]
        x, y = cut[k][m]
        for side in (-1, 1):
            if (d, n + side) in keeper or (k, m + side) in gone_chunks or (k, m + 2 * side) in gone_chunks:
                continue
            while 0 <= n + side < len(cut[d]) and 0 <= m + side < len(cut[k]):
                i, j = (a - 1, x - 1) if side < 0 else (b, y)
                inside = cut[d][n + side][0] <= i < cut[d][n + side][1] and cut[k][m + side][0] <= j < cut[k][m + side][1]
                if not inside or lines[d][i] != lines[k][j]:
                    break
                a, b, x, y = (a - 1, b, x - 1, y) if side < 0 else (a, b + 1, x, y + 1)
        gone[d] |= set(range(a, b))
        runs.append((d, a, b, k, x, y))
    for d, a, b, k, x, y in runs:  # what goes stands whole, on end, at the place that stays
        assert lines[d][a:b] == lines[k][x:y] and not gone[k] & set(range(x, y))
    return gone


def check(rows, got):
    gone = brute({(i, t or "") for i, t in rows})
    want = []
    for i, t in rows:
        cut = gone[i, t or ""]
        kept = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut)
        want.append((i, kept, 0 if t is None else len(t.split("\n")), len(cut)))
    key = lambda r: (r[0], r[1] or "", r[2], r[3])
    assert sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got), key=key) == sorted(want, key=key)
    return sum(r[3] for r in want)


def test_op4_whole_table(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    gone = brute({(i, t or "") for i, t in texts.items()})
    got = registry.queries()["op4_line_dedup"](spark, SF).collect()
    assert len(got) == len(texts) and sum(map(len, gone.values())) > 0
    for r in got:
        cut = gone[r.doc_id, texts[r.doc_id] or ""]
        assert (r.text, r.n_removed) == ("\n".join(x for k, x in enumerate(texts[r.doc_id].split("\n")) if k not in cut), len(cut))


def corpus(seed):
    rng = random.Random(seed)
    line = lambda: " ".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 4)))
    passages = [[line() for _ in range(rng.randrange(2, 25))] for _ in range(12)]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += rng.choice([p, p[a:], p[: a + 1], [line()], [line()] * rng.randrange(1, 7)])
        rows.append((i, "\n".join(parts)))
    return rows + [(60, None), (61, ""), (62, "\n\n\n\n\n"), (63, rows[5][1]), (63, rows[5][1]), (64, "x\n" * 500), (7, "other\ntext of\nthe id")]


@pytest.mark.parametrize("seed", range(3))
def test_random_corpora_with_and_without_broadcasts(spark, monkeypatch, seed):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("cuts", "cut_id", "id", "key", "at", "left", "stays")})
    rows = [r for r in rows if r[0] != 7]  # two texts of one id are told apart by a hash, not in the order of the rule
    df = df.where("doc_id <> 7").repartition(5)
    if seed:
        monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed"]
    assert check(rows, out.collect()) > 100


def test_ids_that_are_null_or_shared(spark):
    body = "\n".join(f"line {k} of the body" for k in range(60))
    rows = [(None, body), (None, body), (7, body + "\nend"), (7, "begin\n" + body), (8, body)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    whole = [r for r in got if r.n_removed == 0]
    assert [r.doc_id for r in whole] == [7] and all(r.n_removed >= 40 for r in got if r not in whole)
    alone = line_dedup.dedup_lines(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()
    assert [r.n_removed for r in alone] == [0, 0]
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passages_that_overlap_are_not_lost(spark):
    """Each line of a text that goes stands elsewhere, whatever overlaps."""
    rows = [(1, "p0\nm\nn"), (2, "m\nn\nk"), (3, "n\nk"), (4, "p0\nm\nn\nk")]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = "\n\0\n".join(r.text for r in got)
    assert all(t in left for t in ("p0\nm\nn", "m\nn\nk", "n\nk"))
    check(rows, got)


def test_boundaries_move_only_beside_a_change():
    rng = random.Random(1)
    lines = [str(rng.random()).encode() for _ in range(400)]
    ends = {(tuple(lines[a:b])) for a, b in line_dedup.chunks(lines)}
    for at in (0, 57, 200, 399):
        changed = {(tuple(x[a:b])) for x in [[*lines[:at], b"new", *lines[at:]]] for a, b in line_dedup.chunks(x)}
        assert len(ends - changed) <= 3
    flat = line_dedup.chunks(lines)
    assert [a for a, _ in flat[1:]] == [b for _, b in flat[:-1]] and flat[0][0] == 0 and flat[-1][1] == 400
    assert line_dedup.chunks([b"x"] * 7) == [(0, 2), (2, 4), (4, 6), (6, 7)] and line_dedup.chunks([b""]) == [(0, 1)]


def test_a_clash_of_hashes_is_seen_in_the_bytes(spark, monkeypatch):
    rows = corpus(9)[:40]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real, places, seeds = line_dedup.chunk_hash, line_dedup.repeated_places, []
    monkeypatch.setattr(line_dedup, "chunk_hash", lambda lines, seed: real(lines, seed) if seed else len(lines))
    monkeypatch.setattr(line_dedup, "repeated_places", lambda d, s: (seeds.append(s), places(d, s))[1])
    check(rows, line_dedup.dedup_lines(docs).collect())
    assert seeds == [0, 1]
