"""Operators 11 to 13 against brute force, on whole tables and on small cases of nulls, ties, repeats and clashing names."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import collocations, registry, sketch, suffix_lm, zorder_layout

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def by_sql(name, view):
    con = duckdb.connect()
    con.register("documents", view) if not isinstance(view, str) else con.sql(f"CREATE VIEW documents AS SELECT * FROM '{view}'")
    return con.sql(registry.oracle_sql()[name]).df()


def same(got, want, keys):
    got, want = (x[sorted(want.columns)].sort_values(keys).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want)
    for c in want.columns:
        assert (got[c] == want[c]).all(), c


# Sketches


def test_sketch_never_counts_low_and_merges(spark):
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    times = np.minimum(rng.zipf(1.6, 3000), 400)
    batches = []
    for part in np.array_split(rng.permutation(np.repeat(keys, times)), 5):
        s = sketch.Sketcher(2**16)
        batches += [*s.add(part), *s.rows()]
    import pyarrow as pa

    rows = spark.createDataFrame(pa.Table.from_batches(batches).to_pandas(), sketch.SCHEMA)
    bits = sketch.heavy_counters(rows, 2**16, 30).value
    found = sketch.may_be_heavy(keys, bits)
    assert found[times >= 30].all() and found.sum() < 1.5 * (times >= 30).sum()


# 8


def test_op8_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    same(registry.queries()["op8_minhash_dedup"](spark, sf).toPandas(), by_sql("op8_minhash_dedup", f"{sf}/documents.parquet"), ["doc_id"])


# 11


def brute_lm(train, docs, depth, share, fewest):
    """Scores by dictionaries; docs are lists of tokens with the end."""
    words = Counter(t for x in train for t in x)
    n, v = sum(words.values()), len(words)
    mass, least = n + 0.1 * (v + 1), max(fewest, math.ceil(share * n))
    root = lambda t: (words[t] + 0.1) / mass
    counts = {k: Counter(tuple(x[i : i + k]) for x in train for i in range(len(x) - k + 1)) for k in range(1, depth + 2)}
    states = {}

    def p(context, t):
        for cut in range(len(context) + 1):
            s = context[cut:]
            if not s:
                return root(t)
            if s in states:
                seen, b = states[s]
                if t in seen:
                    return (seen[t] - 0.6) / counts[len(s)][s] + b * p(s[1:], t)
                return b * p(s[1:], t)

    for k in range(2, depth + 2):
        seen = defaultdict(dict)
        for g, c in counts[k].items():
            if c >= least:
                seen[g[:-1]][g[-1]] = c
        new = {}
        for s, own in seen.items():
            c = counts[k - 1][s]
            b = 1 - (sum(own.values()) - 0.6 * len(own)) / c
            gain = (c - sum(own.values())) * math.log(b)
            for t, m in own.items():
                low = p(s[1:], t)
                gain += m * math.log(((m - 0.6) / c + b * low) / low)
            if gain > 0.5 * math.log(c) * (len(own) + 1):
                new[s] = (own, b)
        states |= new
    scores = [sum(math.log10(p(tuple(x[max(0, i - depth) : i]), x[i])) for i in range(len(x))) for x in docs]
    return scores, states, p, words


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER)), None]


def test_op11_whole_table(spark, documents):
    got = {r.doc_id: r for r in registry.queries()["op11_suffix_lm"](spark, SF).collect()}
    docs = {r["doc_id"]: tokens(r["text"]) for r in documents}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in docs}
    words = Counter(t for i, x in docs.items() if not held[i] for t in x)
    n, v = sum(words.values()), len(words)
    want, *_ = brute_lm([x for i, x in docs.items() if not held[i]], docs.values(), suffix_lm.DEPTH, suffix_lm.SHARE, suffix_lm.FEWEST)
    for (i, x), s in zip(docs.items(), want, strict=True):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(x), sum(words[t] > 0 for t in x), n)
        assert r.base_score == pytest.approx(sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x), rel=1e-9)
        assert r.score == pytest.approx(s, rel=1e-9)
    kept = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in kept) > sum(r.base_score for r in kept)


def test_op11_probabilities_sum_to_one():
    rng = random.Random(3)
    motifs = [list("abcad"), list("ba"), list("cc"), list("e")]
    docs = [[t for _ in range(rng.randrange(1, 9)) for t in rng.choice(motifs)] + [None] for _ in range(300)]
    _, states, p, words = brute_lm(docs, [], 2, 0, 2)
    assert len({len(s) for s in states}) == 2
    for s in states:
        assert sum(p(s, t) for t in words) + 0.1 / (sum(words.values()) + 0.1 * (len(words) + 1)) == pytest.approx(1, abs=0.01)


def test_op11_edge_cases(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choices(["a", "B", "c", "dé", " x"], [5, 4, 3, 2, 1], k=rng.randrange(0, 40))), "n", 1) for i in range(120)]
    rows += [(None, "a b", "n", 1), (None, None, "n", 1), (5, rows[5][1], "n", 1), (900, "", "n", 1), (901, " \t\n", "n", 1), (902, "zz " * 4000, "n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, row int").withColumns({"held_out": F.lit(3), "score": F.lit("x"), "id": F.lit(1), "n": F.lit(2)})
    got = suffix_lm.score(df, depth=2, share=0, fewest=2).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    want, *_ = brute_lm([tokens(r[1]) for r in rows if not held(r[0])], [tokens(r[1]) for r in rows], 2, 0, 2)
    key = lambda i, h, n, s: (str(i), h, n, round(s, 8))
    assert sorted(key(r.doc_id, r.held_out, r.n_tokens, r.score) for r in got) == sorted(key(r[0], held(r[0]), len(tokens(r[1])), s) for r, s in zip(rows, want, strict=True))
    assert suffix_lm.score(df.where("false")).count() == 0
    only = suffix_lm.score(df.where("doc_id is null")).collect()
    assert all(r.train_tokens == 0 and r.held_out and r.n_known == 0 and r.score == pytest.approx(0) for r in only)


@pytest.mark.parametrize(("crowd", "entries", "bucket", "fewest"), [(10**6, 10**6, 10**6, 1), (40, 30, 500, 1), (8, 0, 300, 2)])
def test_op11_leaves_no_phrase_out(spark, monkeypatch, crowd, entries, bucket, fewest):
    # Phrases that occur once or twice are in the tree, whether their contexts are crowded or dealt into buckets, and
    # whether what they start from is broadcast or joined.
    monkeypatch.setattr(suffix_lm, "BUCKET", bucket)
    monkeypatch.setattr(suffix_lm, "CHUNK", 700)
    rng = random.Random(11)
    word = lambda: "abcdefgh"[min(int(rng.expovariate(0.5)), 7)] if rng.random() < 0.8 else f"r{rng.randrange(400)}"
    texts = [" ".join(word() for _ in range(rng.randrange(0, 30))) for _ in range(300)]
    rows = [(i, t) for i, t in enumerate(texts + texts[:20])] + [(None, "r1 a b"), (7, texts[3]), (8, None)]
    got = suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), fewest=fewest, crowd=crowd, entries=entries).collect()
    held = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    docs = [tokens(t) for _, t in rows]
    want, states, _, words = brute_lm([x for (i, _), x in zip(rows, docs, strict=True) if not held(i)], docs, suffix_lm.DEPTH, 0, fewest)
    assert {len(s) for s in states} == {1, 2, 3}
    n, v = sum(words.values()), len(words)
    base = lambda x: sum(math.log10((words[t] + 0.1) / (n + 0.1 * (v + 1))) for t in x)
    line = lambda i, h, k, n, b, s: (str(i), h, k, n, round(b, 7), round(s, 7))
    assert sorted(line(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got) == sorted(line(i, held(i), len(x), sum(words[t] > 0 for t in x), base(x), s) for (i, _), x, s in zip(rows, docs, want, strict=True))


def test_op11_tells_what_occurs_twice(spark):
    # A passage of two texts of a table in which all else occurs once: the default model must know it.
    rng = random.Random(12)
    rows = [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(1, 200)]
    rows += [(1001, rows[4][1]), (1002, rows[6][1])]
    assert all(zlib.crc32(str(i).encode()) % 10 for i in (5, 7, 1001, 1002))
    got = {r.doc_id: r.score / r.n_tokens for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("not held_out").collect()}
    once = [x for i, x in got.items() if i not in (5, 7, 1001, 1002)]
    assert min(got[i] for i in (5, 7, 1001, 1002)) > max(once)


def test_op11_bucket_after_crowded_contexts_alone(spark):
    # All words and pairs are crowded, triples aren't: no symbol of a bucket starts from the root, and all climb.
    rng = random.Random(16)
    rows = []
    for i in range(200):
        x = [0, 1, 2]
        for _ in range(30):
            x.append((x[-1] + 2 * x[-2] + 3 * x[-3]) % 4 if rng.random() < 0.7 else rng.randrange(4))
        rows.append((i, " ".join("abcd"[j] for j in x[3:])))
    got = {r.doc_id: r.score for r in suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string"), crowd=150).collect()}
    train = [tokens(t) for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    want, states, *_ = brute_lm(train, [tokens(t) for _, t in rows], suffix_lm.DEPTH, 0, 1)
    assert any(len(s) == 3 for s in states)
    assert [got[i] for i, _ in rows] == pytest.approx(want, rel=1e-9)


def test_op11_buckets_ask_in_proportion(spark, monkeypatch):
    # Five times the texts, of words most of which are rare in both: what buckets ask for grows alike, not from nothing.
    monkeypatch.setattr(suffix_lm, "FREQUENT", 1 / 4000, raising=False)
    monkeypatch.setattr(suffix_lm, "BUCKET", 500)
    rng = random.Random(14)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(40)) for _ in range(750)]
    entries = len({t for x in texts[:135] for t in x.split()}) + 1

    def asked(n):
        df = spark.createDataFrame([(x,) for x in texts[:n]], "text string").coalesce(1)
        tree, *_ = suffix_lm.fit(df.limit(n * 9 // 10), entries=entries)
        return df.mapInArrow(suffix_lm._asked(spark.sparkContext.broadcast(tree), 1 + tree.n // suffix_lm.BUCKET), "key long, bucket int").count()

    few, many = asked(150), asked(750)
    assert many < 7 * few


def test_op11_sums_meet_in_a_line_for_each_text(spark, monkeypatch):
    # However many tasks the words of a text are dealt to, what is written has one row for it.
    written, stored = {}, suffix_lm.stored
    monkeypatch.setattr(suffix_lm, "stored", lambda df, name: written.setdefault(name, stored(df, name)))
    monkeypatch.setattr(suffix_lm, "BUCKET", 100)
    monkeypatch.setattr(suffix_lm, "FREQUENT", 1 / 1000)
    rng = random.Random(15)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.9))}" for _ in range(30))) for i in range(90)]
    assert suffix_lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), entries=50).count() == 90
    assert written["scored"].count() == 90


# 12


def test_op12_whole_table(spark):
    same(registry.queries()["op12_zorder_layout"](spark, SF).toPandas(), by_sql("op12_zorder_layout", f"{SF}/documents.parquet"), ["position"])


def brute_layout(rows, file_rows):
    """rows: (doc_id, text, lang, source)."""
    low = lambda s: (s is not None, s.encode() if s is not None else b"")
    date = lambda i: zlib.crc32(str(i).encode()) % 365 if i is not None else None
    values = [(low(s), low(g), len(t.encode()) if t is not None else -1, (date(i) is not None, date(i) or 0)) for i, t, g, s in rows]
    n, axes = len(rows), []
    for k in range(4):
        column = sorted(v[k] for v in values)
        first = {}
        for at, v in enumerate(column):
            first.setdefault(v, at)
        axes.append([16 * first[v[k]] // n for v in values])
    points = list(zip(*axes, strict=True))
    z = [int("".join(format(x, "04b")[b] for b in range(4) for x in p), 2) for p in points]
    order = sorted(range(n), key=lambda i: (z[i], rows[i][0] is not None, rows[i][0] or 0))
    file = {i: at // file_rows for at, i in enumerate(order)}
    held = defaultdict(list)
    for i in order:
        held[file[i]].append(points[i])
    boxes = {f: [(min(p[k] for p in ps), max(p[k] for p in ps)) for k in range(4)] for f, ps in held.items()}
    reach = (0, 0, 2, 2)
    out = []
    for at, i in enumerate(order):
        p = points[i]
        touched = sum(all(b[k][0] - reach[k] <= p[k] <= b[k][1] + reach[k] for k in range(4)) for b in boxes.values())
        inside = sum(any(all(abs(q[k] - p[k]) <= reach[k] for k in range(4)) for q in ps) for ps in held.values())
        out.append((rows[i][0], z[i], at, file[i], touched, inside, ",".join(f"{a},{b}" for a, b in boxes[file[i]])))
    return out


def test_op12_small_files_against_brute_force(spark):
    rng = random.Random(11)
    rows = [(rng.choice([None, *range(400)]), rng.choice([None, "", "x" * rng.randrange(300), "é" * rng.randrange(9)]), rng.choice([None, "de", "en", "en", "zz"]), rng.choice([None, "hot", "hot", "a\U0001f600", "a￿", f"s{rng.randrange(40)}"])) for _ in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"z": F.lit(1), "file": F.lit("f"), "id": F.lit(2), "at": F.lit(0), "x_date": F.lit(1)}).repartition(7)
    got = [tuple(r) for r in zorder_layout.layout(df, file_rows=20).orderBy("position").collect()]
    want = brute_layout(rows, 20)
    # Rows of one cell and id are alike in all that is returned.
    assert got == want
    assert zorder_layout.layout(df.where("false")).count() == 0
    one = zorder_layout.layout(df.limit(1)).collect()
    assert [(r.z, r.position, r.file, r.files_touched, r.files_matching, r.file_bounds) for r in one] == [(0, 0, 0, 1, 1, "0,0,0,0,0,0,0,0")]


# 13


def test_op13_whole_table(spark):
    same(registry.queries()["op13_collocations"](spark, SF).toPandas(), by_sql("op13_collocations", f"{SF}/documents.parquet"), ["lang", "rank"])


def brute_phrases(rows, least, top):
    count, total = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    longer, out = Counter(), defaultdict(list)
    for (lang, w), a in count.items():
        if a >= least and len(w) > 2:
            for m in range(2, len(w)):
                for i in range(len(w) - m + 1):
                    longer[lang, w[i : i + m]] = max(longer[lang, w[i : i + m]], a)
    for (lang, w), a in count.items():
        if a >= least and len(w) > 1 and 100 * longer[lang, w] < 80 * a:
            score, k = min((2000000 * a // (count[lang, w[:k]] + count[lang, w[k:]]), k) for k in range(1, len(w)))
            out[lang].append((-score, -a, " ".join(w).encode(), " ".join(w), count[lang, w[:k]], count[lang, w[k:]]))
    return {(lang, rank + 1, r[3], -r[1], r[4], r[5], total[lang], -r[0]) for lang, rows in out.items() for rank, r in enumerate(sorted(rows)[:top])}


def test_op13_small_cases(spark):
    rng = random.Random(13)
    vocabulary = ["new", "York", "city", "the", "of", "été", " ", "x\u000by", "z"]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for _ in range(rng.randrange(60)))
    rows = [(rng.choice(["en", "en", "de", None, "und", ""]), text()) for _ in range(150)] + [("en", None), ("en", ""), (None, "."), ("fr", "the of " * 9000), ("fr", "lone")]
    df = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("p"), "n": F.lit(1), "rank": F.lit(2), "w": F.lit(0), "k": F.lit(1)}).repartition(5)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    for least, top in ((3, 2000), (5, 4)):
        got = [tuple(r[c] for c in names) for r in collocations.collocations(df, least=least, top=top).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least, top)
    assert collocations.collocations(df.where("false")).count() == 0


def test_op13_small_sketch_and_cut_texts_lose_nothing(spark, monkeypatch):
    rng = random.Random(17)
    rows = [("en", "".join(rng.choice("abcdefg") + rng.choice([" ", " ", " ", "; "]) for _ in range(400))) for _ in range(30)]
    df = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(sketch, "LEAST_WIDTH", 16)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = {tuple(r[c] for c in names) for r in collocations.collocations(df, least=3, width=16).collect()}
    assert got == brute_phrases(rows, 3, 2000)
    cut = [p for texts, _ in collocations.slices(iter([(r[1].encode(), 0) for r in rows]), 100) for p in texts]
    assert b"".join(cut) == "".join(r[1] for r in rows).encode() and max(map(len, cut)) < 200


def test_op13_products_beyond_64_bits(spark):
    """Counts as they'd be in a corpus of 10^14 words: the same expressions over planted counts."""
    a, half = 9_000_000_000_000, 9_200_000_000_000
    r = spark.range(1).select(F.expr(f"cast({a} as decimal(20,0)) * cast(2000000 as decimal(7,0)) div (cast({half} as decimal(20,0)) + cast({half} as decimal(20,0)))").alias("s")).first()
    assert r.s == 2_000_000 * a // (2 * half)
