"""The queries themselves at the smallest size, and the pipeline: contract columns against brute force."""

import hashlib
import importlib.util
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lectern.llm import embedding_dedup, exact_dedup, minhash_dedup, quality, registry, secret_scan, shared, toxicity

SF = "/root/testdata/sf0.001"


def read(name, columns=None):
    return pq.read_table(f"{SF}/{name}.parquet", columns=columns).to_pylist()


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in read("documents", ["doc_id", "text"])}


def run(spark, name):
    return {r[0]: r for r in registry.queries()[name](spark, SF).collect()}


def test_op1(spark, texts):
    got = run(spark, "op1_toxicity")
    assert got.keys() == texts.keys()
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_op2(spark, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(tok.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    got = registry.queries()["op2_packing"](spark, SF).collect()
    covered, at = {}, {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        assert r.start == covered.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] = r.start + r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert covered == {i: len(x) for i, x in ids.items()}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at))) and all(n == 1024 for s, n in at.items() if s != max(at))


def test_op3(spark, texts):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    got = run(spark, "op3_secret_scan")
    for i, t in texts.items():
        base = [[(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6], [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20], [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [len(x) for x in base]
        line = ",".join(f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(sum(base, [])))
        assert got[i].base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert set(filter(None, line.split(","))) <= set(got[i].spans.split(","))


def test_op5(spark, texts):
    import public_tokenizers
    import tiktoken

    from lectern.llm import bpe

    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, r in run(spark, "op5_bpe").items():
        ids = np.array(lib.encode_ordinary(texts[i]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[i].encode()).hexdigest())


def test_op6_recall(spark):
    rows = read("embeddings", ["vec_id", "embedding"])
    x = np.array([r["embedding"] for r in rows], np.float32).astype(np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.95) & ~np.eye(len(u), dtype=bool)
    got = run(spark, "op6_embedding_dedup")
    assert all(got[r["vec_id"]].n_links <= n for r, n in zip(rows, link.sum(1)))
    assert sum(r.n_links for r in got.values()) >= 0.9 * link.sum()
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def brute(texts, width):
    sets, root = {}, {i: i for i in texts}
    for i, t in texts.items():
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    links = [(a, b) for k, a in enumerate(order) for b in order[k + 1 :] if 100 * len(sets[a]) >= 80 * len(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        new = dict(root)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == root:
            return {i: (len(sets[i]), root[i]) for i in sets}
        root = new


def test_op8(spark, texts):
    got = run(spark, "op8_minhash_dedup")
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute(texts, 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_op9(spark, texts):
    got, last, n = run(spark, "op9_exact_dedup"), {}, {}
    for i, t in sorted(texts.items()):
        last[t], n[t] = i, n.get(t, 0) + 1
    for i, t in texts.items():
        assert tuple(got[i]) == (i, last[t], n[t], last[t] == i, hashlib.sha256(t.encode()).hexdigest())


def test_op10_and_op7_cover_all_rows(spark, texts):
    good = run(spark, "op10_quality")
    assert good.keys() == texts.keys() and all(0 <= r.score <= 1 and 0 <= r.weak <= 1 and r.keep == int(r.score >= 0.5) for r in good.values())
    assert run(spark, "op7_license_scan").keys() == texts.keys()


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not here")
def test_pipeline(spark, texts):
    sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        out = shared.stored(stage(spark, docs, SF), name)
        assert out.columns == docs.columns
        kept.append({r.doc_id: r.text or "" for r in out.select("doc_id", "text").collect()})
        docs = out
    toxic = {i for i, r in run(spark, "op1_toxicity").items() if r.predicted}
    assert kept[0].keys() == texts.keys() - toxic
    assert kept[1].keys() == {max(j for j in kept[0] if kept[0][j] == t) for t in kept[0].values()}
    assert kept[2].keys() == {i for i, (_, root) in brute(kept[1], 5).items() if root == i}
    spans = {r.doc_id: r.spans for r in secret_scan.secret_report(spark.createDataFrame(list(kept[2].items()), "doc_id long, text string")).collect()}
    assert kept[3].keys() == kept[2].keys() and all((kept[3][i] == t) == (spans[i] == "") for i, t in kept[2].items())
    pieces = P.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == kept[3].keys()
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


# Cases beside the queries.


def test_toxicity_of_a_text_is_its_own(spark):
    rows = [(f"{'vile rubbish' if i % 3 == 0 else 'green stone'} river {i % 17} light water", i % 3 == 0) for i in range(300)]
    net = toxicity.train([t for t, _ in rows], [int(y) for _, y in rows])
    some = ["rubbish", "lin vile stone", "green", "", "x" * 50, "vile " * 500, None, "vile"]
    alone = [net.scores([t])[0] for t in some]
    assert alone == net.scores(some).tolist() == net.scores(some[::-1]).tolist()[::-1]
    assert net.scores(["lin vile stone"] * 2).tolist() == [alone[1]] * 2


def test_toxicity_without_labels_rejects_nothing(spark):
    docs = spark.createDataFrame([(i, "a text of some words") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, None) for i in range(20)], "doc_id long, toxic int")
    for known in (labels, labels.limit(0)):
        assert toxicity.toxicity(docs, toxicity.fit(docs, known)).where("predicted = 1").count() == 0


def test_near_dedup_ties_ids_and_columns(spark):
    words = [f"w{k}" for k in range(100)]
    tie = lambda n: " ".join(words[: 12 - n] + [f"z{k}" for k in range(n)])
    rows = [(1, tie(0)), (2, tie(1)), (3, " ".join(words[50:90])), (4, " ".join(words[50:90])), (4, "a b c d e f g"), (5, "A b c d e f g"), (None, tie(0)), (6, " ".join(words[:4] * 3)), (7, "")]
    docs = spark.createDataFrame([(i, t, "n", "k") for i, t in rows], "doc_id long, text string, near_id string, digest string")
    # Nine 4-word shingles each, eight shared: 8 of 10 is the least that links.
    got = minhash_dedup.minhash_dedup(docs, width=4, percent=80).collect()
    by = {(r.doc_id, r.text): r for r in got}
    assert len(got) == len(rows) and got[0].near_id == "n"
    assert {by[1, tie(0)].component_id, by[2, tie(1)].component_id} == {1}
    # Documents 3 and 4 share a text, 4 and 5 another, so all three are one.
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert by[None, tie(0)].component_id is None and by[None, tie(0)].kept and by[7, ""].kept
    kept = minhash_dedup.drop_near_duplicates(docs, width=4, percent=80)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_embedding_ties_lengths_and_bad_components(spark):
    nan, inf = float("nan"), float("inf")
    edge = [0.95, float(np.sqrt(1 - 0.95**2))]
    rows = [(1, [1.0, 0.0, 0.0]), (2, [2.0, 0.0, 0.0]), (3, [1.0, 0.0]), (4, [3.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [nan, 0.0, 0.0]), (7, [inf, 0.0, 0.0]), (8, [1.0, None, 0.0]), (9, [0.0] * 3), (10, None), (11, []), (12, [0.5]), (13, [0.25]), (14, [-1.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in got.items()} == {i: (0, i) for i in got} | {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 12: (1, 12), 13: (1, 12)}
    x = np.array(edge, np.float32).astype(float)
    exact = float(x[0] / np.sqrt((x * x).sum()))
    pair = spark.createDataFrame([(1, [1.0, 0.0]), (2, edge)], "vec_id long, embedding array<float>")
    for least, links in ((exact - 1e-12, 1), (exact + 1e-9, 0)):
        assert {r.n_links for r in embedding_dedup.near_vectors(pair, cosine=least).collect()} == {links}


def test_secret_parts_at_the_scopes_end(spark):
    part = "Zm9vYmFyYmF6cXV4Zm9vYmFyYmF6cXV4MTIzNDU2"
    make = lambda gap: "x" * 22 + " login: bob" + " " * gap + part
    mirror = lambda gap: "y" * 3 + " " + part + " " * gap + "login: bob"
    rows = [(k, f(g)) for k, (f, g) in enumerate((f, g) for f in (make, mirror) for g in (1, 168, 199, 200, 201, 367))]
    shifted = [(100 + s, "." * s + make(200)) for s in range(0, 200, 7)] + [(400 + s, "." * s + mirror(200)) for s in range(0, 200, 7)]
    got = {r.doc_id: r.spans for r in secret_scan.secret_report(spark.createDataFrame(rows + shifted, "doc_id long, text string")).collect()}
    assert [got[k] != "" for k, _ in rows] == [True, True, True, True, False, False] * 2
    assert all(got[k] for k, _ in shifted)


def test_secrets_of_a_text_with_many(spark, monkeypatch):
    text = "é " + " ".join(f"token=abcdef{k:05d} 😀" for k in range(3000))
    docs = spark.createDataFrame([(1, text, "s", "c"), (2, "no", "s", "c")], "doc_id long, text string, secret_spans string, clean_text string")
    want = "é " + " ".join("[secret] 😀" for _ in range(3000))
    for rows in (shared.BROADCAST_ROWS, 0):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", rows)
        out = secret_scan.redact(docs)
        assert out.columns == docs.columns and {r.doc_id: (r.text, r.clean_text) for r in out.collect()} == {1: (want, "c"), 2: ("no", "c")}
    r = secret_scan.secret_report(docs).where("doc_id = 1").first()
    assert r.n_assign == 3000 and r.spans.split(",")[-1] == f"assign:{len(text) - 19}:{len(text) - 2}"


def test_exact_dedup_without_broadcast(spark, monkeypatch):
    rows = [(i, f"text {i % 7}" if i % 3 else None, "x", "y") for i in range(60)] + [(None, "text 1", "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, _size string").repartition(9)
    seen = []
    for most in (shared.BROADCAST_ROWS, 0):
        monkeypatch.setattr(shared, "BROADCAST_ROWS", most)
        for fan in (2, 8):
            for keep in ("min", "max"):
                out = exact_dedup.exact_dedup(docs, keep=keep, fan_in=fan)
                assert out.columns == [*docs.columns, "keep_id", "group_size", "kept", "text_sha256"]
                seen.append((keep, sorted(map(str, out.select("doc_id", "keep_id", "group_size", "_size").collect()))))
    assert len({str(x) for k, x in seen if k == "min"}) == 1 and len({str(x) for k, x in seen if k == "max"}) == 1
    assert exact_dedup.exact_dedup(docs).where("text = 'text 1'").agg(F.min("keep_id"), F.max("keep_id")).first()[:] == (1, 1)


def test_estimation_recovers_planted_accuracies():
    r = np.random.default_rng(4)
    n, speaks = 40_000, np.array([[0.8, 0.6, 0.7, 0.4, 0.05, 0.5], [0.02, 0.05, 0.01, 0.1, 0.05, 0.2]])
    bad = r.random(n) < 0.2
    v = r.random((n, 6)) < np.where(bad[:, None], speaks[0], speaks[1])
    seen, counts = np.unique(quality.pattern(v), return_counts=True)
    posterior, found, share = quality.estimate(seen, counts.astype(float), 6)
    assert np.abs(found - speaks).max() < 0.05 and abs(share - 0.2) < 0.02
    own = posterior[np.searchsorted(seen, quality.pattern(v))]
    assert ((own < 0.5) == bad).mean() > 0.95


def test_frames_are_bounded_by_bytes(spark):
    def sizes(frames):
        for f in frames:
            yield pa.RecordBatch.from_arrays([pa.array([f.num_rows]), pa.array([f.nbytes])], ["n", "bytes"])

    shared.prepare(spark)
    texts = spark.range(0, 6000, 1, 1).select(F.repeat(F.lit("long line "), 400).alias("text"))
    got = texts.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in got) == 6000 and max(r.bytes for r in got) <= shared.FRAME + 100_000
