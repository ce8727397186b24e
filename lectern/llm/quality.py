"""Quality classifier (10): a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers each look for one defect and call a text bad or stay silent; each defect is
seen by two or three of them. Expectation-maximisation over the counts of all vote patterns (at most 2 to the
number of labellers, however many texts) estimates the share of bad texts and each labeller's accuracy, how often
it speaks on bad and on good texts; no label is read. A labeller that speaks where no other does is so found
wrong, one that others confirm is found right. Beliefs count as much as PSEUDO texts, so data outvote them. The
posterior of a text's votes then trains, on a bounded sample, a linear scorer over hashed words and word
shapes, which scores every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .pretoken import spans
from .shared import prepare, stored, table, trim

#: Labeller, and the value of its feature from which (or down to which) it calls a text bad.
LABELLERS = [
    ("symbols", 0.03, "above"),
    ("marked", 0.20, "above"),
    ("letters", 0.72, "below"),
    ("upper", 0.30, "above"),
    ("shouted", 0.30, "above"),
    ("repeats", 0.20, "above"),
    ("variety", 0.15, "below"),
    ("common", 0.30, "above"),
    ("breaks", 0.30, "below"),
    ("digits", 0.15, "above"),
    ("words", 1.0, "below"),
    ("length", 2.0, "below"),
]
#: Beliefs about any labeller: how often it speaks on bad and on good texts, and the texts that they count for.
BELIEF, PSEUDO = (0.2, 0.02), 20.0
#: Hashed features; bounds of the training sample; passes over it; a text with this score or more is kept.
FEATURES, SAMPLE_ROWS, SAMPLE_CHARS, PASSES, THRESHOLD = 4096, 3000, 20_000, 60, 0.5

_LETTER, _UPPER, _DIGIT, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[0x41:0x5B] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_DIGIT[0x30:0x3A] = True
_SYMBOL[[ord(c) for c in "#$%&*|<>{}[]^~\\=+@_"]] = True
_SYMBOL[0x21] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".?!"]] = True


def _raw(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts


def _per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums over each text's stretch; stretches may be empty."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return sums[starts[1:]] - sums[starts[:-1]]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values for the labellers (one row a text), hashed features of all words, and where each text's words start."""
    data, starts = _raw(texts)
    lower, _ = tb.join_texts(texts)
    first, end, hashes, bounds = tb.words(lower, starts)
    count = np.maximum(np.diff(bounds), 1)
    size = np.maximum(np.diff(starts) - 1, 1)
    letters = np.maximum(_per_text(_LETTER[data], starts), 1)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    again[bounds[:-1][np.diff(bounds) > 0]] = False
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    order = np.lexsort((hashes, owner))
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    variety = np.bincount(owner[order][new], minlength=len(texts)) / np.sqrt(count) / 10
    stops = _per_text(_STOP[data], starts) / np.maximum(count / 25, 1)
    last = data[np.maximum(end - 1, 0)]
    shape = _UPPER[data[first]] + 2 * _UPPER[last] + 4 * _DIGIT[last] + 8 * _SYMBOL[last] + 16 * _STOP[last] + 32 * again + 64 * _SYMBOL[data[first]]
    shape = shape + 128 * np.minimum(end - first, 15)
    # How often each text's most common word occurs; one of few words says nothing.
    group = np.cumsum(new) - 1
    often = np.zeros(len(texts))
    if len(group):
        np.maximum.at(often, owner[order][new], np.bincount(group))
    many = np.diff(bounds) >= 10
    inner = data[np.minimum(first + 1, np.maximum(end - 1, 0))]
    values = np.stack(
        [
            _per_text(_SYMBOL[data], starts) / size,
            _per_text(_SYMBOL[last], bounds) / count,
            letters / np.maximum(size - count, 1) + ~many,
            _per_text(_UPPER[data], starts) / letters,
            _per_text(_UPPER[data[first]] & _UPPER[inner], bounds) / count,
            _per_text(again, bounds) / count,
            variety + (np.diff(bounds) < 30),
            often / count * many,
            np.minimum(stops, 1),
            _per_text(_DIGIT[data], starts) / size,
            np.diff(bounds).astype(np.float64),
            letters / count,
        ],
        axis=1,
    )
    half = np.uint64(FEATURES // 2)
    shaped = (tb.mix(shape.astype(np.uint64) + np.uint64(99)) % half).astype(np.int64)
    worded = (hashes % half).astype(np.int64) + FEATURES // 2
    return values, np.stack([shaped, worded], 1), bounds


def votes(values: np.ndarray) -> np.ndarray:
    """Whether each labeller calls each text bad."""
    bad = np.array([x for _, x, _ in LABELLERS])
    return np.where(np.array([side == "above" for *_, side in LABELLERS]), values >= bad, values <= bad)


def pattern(v: np.ndarray) -> np.ndarray:
    """A text's votes as one number, a bit for each labeller."""
    return v @ (1 << np.arange(v.shape[1]))


def estimate(patterns: np.ndarray, counts: np.ndarray, labellers: int = len(LABELLERS), rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior that a text with each pattern is good; how often each labeller speaks on bad texts and on good
    ones; the share of bad texts. Two classes, labellers independent within each.

    At first two voices count as bad, one as undecided. Where no pattern has two voices nothing tells the
    accuracies apart, and beliefs decide.
    """
    v = (patterns[:, None] >> np.arange(labellers) & 1).astype(np.float64)
    voices = v.sum(1)
    bad = np.where(voices >= 2, 0.95, np.where(voices == 1, 0.5, 0.02))
    believed = np.array(BELIEF)[:, None] * PSEUDO
    speaks, share = np.zeros((2, labellers)), 0.0
    for _ in range(rounds):
        weights = np.stack([bad, 1 - bad]) * counts
        total = weights.sum(1)
        share = float((total[0] + 1) / (total.sum() + 2))
        speaks = (weights @ v + believed) / (total[:, None] + PSEUDO)
        logs = np.log([share, 1 - share])[:, None] + np.log(speaks) @ v.T + np.log1p(-speaks) @ (1 - v).T
        bad = 1 / (1 + np.exp(np.clip(logs[1] - logs[0], -500, 500)))
    return 1 - bad, speaks, share


def train(texts: list[bytes], posterior: np.ndarray) -> np.ndarray:
    """Weights of the hashed features, and the bias at the end."""
    x = np.zeros((len(texts), FEATURES + 1), np.float32)
    for a, b in tb.batches(texts):
        _, found, bounds = features(texts[a:b])
        for i in range(b - a):
            f = found[bounds[i] : bounds[i + 1]].ravel()
            if len(f):
                x[a + i, :FEATURES] = np.bincount(f, minlength=FEATURES) * (2.0 / len(f))
    x[:, -1] = 1
    w, m, v, y = np.zeros(FEATURES + 1, np.float32), 0.0, 0.0, posterior.astype(np.float32)
    w[-1] = np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)) if len(y) else 0
    for step in range(1, (PASSES if len(y) else 0) + 1):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (0.5 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with weak (the votes' posterior), score (0 to 1, higher is better) and keep (int).

    Null and empty texts have no words; their score is the scorer's bias alone. Columns of ``docs`` named like
    the results are replaced. Rows stay where they are; repeated rows are scored alike. An empty table gives none.
    """
    spark = prepare(docs.sparkSession)
    plain = docs.drop("weak", "score", "keep")

    def parts(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
        for frame in frames:
            for a, b in spans(frame.column(column)):
                part = frame.slice(a, b - a)
                yield part, [(t or "").encode() for t in part.column(column).to_pylist()]
        trim()

    def cast(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, raw in parts(frames, 0):
            seen, n = np.unique(pattern(votes(features(raw)[0])), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n, pa.int64())], ["pattern", "n"])

    counted = stored(plain.select(text_col).mapInArrow(cast, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")), "votes").collect()
    known = np.array(sorted((r.pattern, r.n) for r in counted) or [(0, 1)], np.int64)
    posterior = estimate(known[:, 0], known[:, 1].astype(np.float64))[0]

    def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, found = [], []
        for _, texts in parts(frames, 0):
            raw += texts
            found.append(pattern(votes(features(texts)[0])))
        if raw:
            weights = train(raw, posterior[np.searchsorted(known[:, 0], np.concatenate(found))])
            yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    hashed = plain.select(F.col(text_col).alias("text"), F.xxhash64(text_col, id_col).alias("h")).where(F.length("text") <= SAMPLE_CHARS)
    # The sample's last hash comes first, so that no partition sends more texts than the sample takes of it. One
    # task reads the sample and trains; only the weights come to the driver.
    last = hashed.select("h").orderBy("h").limit(SAMPLE_ROWS).agg(F.max("h")).first()[0]
    picked = hashed.where(F.col("h") <= F.lit(last)).orderBy("h", "text").limit(SAMPLE_ROWS).select("text")
    made = picked.repartition(1).mapInArrow(learn, "weights binary").collect()
    weights = np.frombuffer(made[0].weights, np.float32) if made else train([], np.zeros(0))
    model = spark.sparkContext.broadcast((known[:, 0], posterior, weights))
    at, schema = plain.columns.index(text_col), docs.drop("weak", "score", "keep").schema.add("weak", "double").add("score", "double")
    names = schema.fieldNames()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, post, w = model.value
        for part, raw in parts(frames, at):
            values, hashed, bounds = features(raw)
            n = np.maximum(np.diff(bounds), 1)
            score = 1 / (1 + np.exp(-(_per_text(w[hashed].sum(1), bounds) / n + w[-1])))
            own = post[np.minimum(np.searchsorted(seen, pattern(votes(values))), len(seen) - 1)]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.float64()), pa.array(score, pa.float64())], names)

    return plain.mapInArrow(run, schema).withColumn("keep", (F.col("score") >= THRESHOLD).cast("int"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "weak", "score", "keep")
