"""Toxicity (1): a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as the embedding of the word beside the mean embedding of its character sequences (hashed
runs of GRAM bytes, the break before the word included). The network reads windows of WINDOW words, each half
over the next, that cover the whole text; a text's score is that of its highest window. Training is on a bounded sample of labelled rows: each round finds
the highest window of every sample text and fits the network to the text's label on it, so the windows
of clean texts that look worst are what it learns from. The embeddings of words and of character sequences
start with the smoothed log odds of their presence in toxic sample texts.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .pretoken import spans
from .shared import prepare, table, trim

WINDOW, STEP = 32, 16
#: Sizes of the word and character embeddings, of each direction's state, and of the attention layer.
WORD, CHAR, STATE, ATTENTION = 8, 8, 8, 8
#: Bounds of the training sample: rows, characters of a row, words with an embedding of their own.
SAMPLE_ROWS, SAMPLE_CHARS, VOCABULARY = 4000, 20_000, 16_384
EPOCHS, BATCH, RATE, SEED = 4, 128, 0.015, 1
#: Bytes of a character sequence, the embeddings that sequences are hashed to, the rows that odds are smoothed with.
GRAM, GRAMS, SMOOTH = 4, 16_384, 10
#: Windows that are scored at once.
PART = 8192
#: A text with this score or more is rejected.
THRESHOLD = 0.3


def _split(texts: list[bytes]):
    """Bytes, each word's first byte, end and hash, where each text's words start, and where its bytes start.

    Between texts stand as many blanks as a character sequence looks back over, so none reaches into another text.
    """
    data, starts = tb.join_texts(texts, GRAM - 1)
    return data, *tb.words(data, starts, tb.NOT_ALNUM), starts


def _codes(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """The character sequence that ends at each of the bytes from a to b, as the number of its embedding."""
    low = max(0, a - GRAM + 1)
    part = data[low:b]
    plain = np.where(tb.NOT_ALNUM[part], np.uint32(0), part.astype(np.uint32))
    code = plain.copy()
    for k in range(1, GRAM):
        code[k:] ^= np.left_shift(plain[:-k], np.uint32(8 * k))
    return (code[a - low :] * np.uint32(2654435761) >> np.uint32(32 - GRAMS.bit_length() + 1)).astype(np.int32)


def _odds(total: np.ndarray, toxic: np.ndarray, prior: float) -> np.ndarray:
    share = (toxic + SMOOTH / (1 + np.exp(-prior))) / (total + SMOOTH)
    return np.clip(np.log(share / (1 - share)) - prior, -1, 4).astype(np.float32)


def _presence(keys: np.ndarray, bounds: np.ndarray, y: np.ndarray, size: int, texts: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """For each key the texts that have it, and the toxic ones; a few texts at a time."""
    total, toxic = np.zeros(size, np.int64), np.zeros(size)
    for a in range(0, len(y), texts):
        ends = bounds[a : a + texts + 1]
        owner = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        pairs = np.unique(keys[ends[0] : ends[-1]].astype(np.int64) * texts + owner)
        key = pairs // texts
        total += np.bincount(key, minlength=size)
        toxic += np.bincount(key, weights=y[a + pairs % texts], minlength=size)
    return total, toxic


def _windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: first word, number of words, text. The last one of a text ends with it."""
    n = np.diff(bounds)
    count = np.where(n > WINDOW, 1 + -(-(n - WINDOW) // STEP), (n > 0).astype(np.int64))
    text = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    first = np.minimum(k * STEP, np.maximum(n[text] - WINDOW, 0)) + bounds[:-1][text]
    return first, np.minimum(n[text], WINDOW), text


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


class Network:
    """The parameters, as arrays by name, and the sorted hashes of the words with an embedding."""

    def __init__(self, vocabulary: np.ndarray, odds: np.ndarray, gram_odds: np.ndarray, prior: float):
        rng = np.random.default_rng(SEED)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary, self.prior = vocabulary, prior
        words = (0.1 * rng.standard_normal((len(vocabulary) + 1, WORD))).astype(np.float32)
        words[1:, 0] = odds
        words[0, 0] = 0
        chars = (0.1 * rng.standard_normal((GRAMS, CHAR))).astype(np.float32)
        chars[:, 0] = gram_odds
        self.p = {"words": words, "chars": chars, "wa": make(2 * STATE, ATTENTION), "va": make(ATTENTION), "wo": make(2 * STATE), "bo": np.array([prior], np.float32)}
        for d in "fb":
            self.p |= {f"wx{d}": make(WORD + CHAR, 3 * STATE), f"bx{d}": np.zeros(3 * STATE, np.float32), f"u{d}": make(STATE, 3 * STATE)}

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 and up for words of the vocabulary, else 0."""
        if not len(self.vocabulary):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def inputs(self, data: np.ndarray, first: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of words in order, from the bytes of all texts."""
        p, n = self.p, len(first)
        if not n:
            return np.zeros((0, WORD + CHAR), np.float32)
        edges, low = np.empty(2 * n, np.int64), int(first[0])
        edges[::2], edges[1::2] = first - low, end - low
        chars = np.add.reduceat(p["chars"][_codes(data, low, int(end[-1]) + 1)], edges, axis=0)[::2] / (end - first)[:, None].astype(np.float32)
        return np.concatenate([p["words"][ids], chars], axis=1)

    def _run(self, x: np.ndarray, live: np.ndarray | None, d: str, keep: bool):
        """x: time, window, input. States in time order; with ``keep`` also what backward() needs."""
        p, (t, b, _) = self.p, x.shape
        xp = (x.reshape(t * b, -1) @ p[f"wx{d}"] + p[f"bx{d}"]).reshape(t, b, 3 * STATE)
        h, out, kept, u = np.zeros((b, STATE), np.float32), np.empty((t, b, STATE), np.float32), {}, p[f"u{d}"]
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = h @ u
            gates = _sigmoid(xp[k, :, : 2 * STATE] + g[:, : 2 * STATE])
            z, r, gn = gates[:, :STATE], gates[:, STATE:], g[:, 2 * STATE :]
            n = np.tanh(xp[k, :, 2 * STATE :] + r * gn)
            new = n + z * (h - n)
            if live is not None:
                new = np.where(live[k][:, None], new, h)
            if keep:
                kept[k] = (h, z, r, gn, n)
            h = out[k] = new
        return out, kept

    def forward(self, x: np.ndarray, live: np.ndarray | None, keep: bool = False):
        p = self.p
        (f, kf), (g, kg) = self._run(x, live, "f", keep), self._run(x, live, "b", keep)
        h = np.concatenate([f, g], axis=2)
        hidden = np.tanh(h @ p["wa"])
        scores = hidden @ p["va"]
        if live is not None:
            scores = np.where(live, scores, np.float32(-1e9))
        weights = np.exp(scores - scores.max(0))
        weights /= weights.sum(0)
        pooled = np.einsum("tb,tbh->bh", weights, h)
        return pooled @ p["wo"] + p["bo"][0], (x, live, h, hidden, weights, pooled, kf, kg) if keep else None

    def backward(self, dlogit: np.ndarray, state: tuple) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters but the embeddings, and of the inputs."""
        p, (x, live, h, hidden, weights, pooled, kf, kg) = self.p, state
        g = {"wo": pooled.T @ dlogit, "bo": np.array([dlogit.sum()], np.float32)}
        dpooled = dlogit[:, None] * p["wo"]
        dw = np.einsum("bh,tbh->tb", dpooled, h)
        ds = weights * (dw - (weights * dw).sum(0))
        dh = weights[:, :, None] * dpooled + 0
        dhid = ds[:, :, None] * p["va"] * (1 - hidden * hidden)
        g["va"] = np.einsum("tb,tba->a", ds, hidden)
        g["wa"] = np.einsum("tbh,tba->ha", h, dhid)
        dh += dhid @ p["wa"].T
        dx = np.zeros_like(x)
        for d, kept, part in (("f", kf, dh[:, :, :STATE]), ("b", kg, dh[:, :, STATE:])):
            u, wx = p[f"u{d}"], p[f"wx{d}"]
            du, dwx, dbx, carry = np.zeros_like(u), np.zeros_like(wx), np.zeros(3 * STATE, np.float32), 0
            for k in range(len(x) - 1, -1, -1) if d == "f" else range(len(x)):
                h0, z, r, gn, n = kept[k]
                total = part[k] + carry
                on = total if live is None else np.where(live[k][:, None], total, 0)
                dn = on * (1 - z) * (1 - n * n)
                dz = on * (h0 - n) * z * (1 - z)
                dr = dn * gn * r * (1 - r)
                dxp = np.concatenate([dz, dr, dn], axis=1)
                dg = np.concatenate([dz, dr, dn * r], axis=1)
                carry = on * z + dg @ u.T + (total - on)
                du += h0.T @ dg
                dwx += x[k].T @ dxp
                dbx += dxp.sum(0)
                dx[k] += dxp @ wx.T
            g |= {f"u{d}": du, f"wx{d}": dwx, f"bx{d}": dbx}
        return g, dx

    def window_logits(self, inputs: np.ndarray, first: np.ndarray, length: np.ndarray, most: int = 1024) -> np.ndarray:
        out = np.empty(len(first), np.float32)
        for at in range(0, len(first), most):
            f, n = first[at : at + most], length[at : at + most]
            step = np.arange(WINDOW)[:, None]
            live = step < n if (n < WINDOW).any() else None
            out[at : at + most] = self.forward(inputs[f + (step if live is None else np.minimum(step, n - 1))], live)[0]
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Of each whole text, from 0 to 1; a text without words has the share of toxic rows in the sample.

        Scores are rounded, so that a difference by the texts that happen to be scored together is rare: only where a
        score lies at the edge of two roundings.
        """
        raw, out = [(t or "").encode() for t in texts], np.full(len(texts), self.prior, np.float64)
        for a, b in tb.batches(raw):
            data, starts, end, hashes, bounds, _ = _split(raw[a:b])
            first, length, text = _windows(bounds)
            ids, best = self.word_ids(hashes), np.full(b - a, -np.inf)
            for w in range(0, len(first), PART):
                some = slice(w, w + PART)
                words = slice(first[some].min(), (first[some] + length[some]).max())
                logits = self.window_logits(self.inputs(data, starts[words], end[words], ids[words]), first[some] - words.start, length[some])
                np.maximum.at(best, text[some], logits)
            out[a:b] = np.where(np.isfinite(best), best, out[a:b])
        return np.round(1 / (1 + np.exp(-out)), 4)


def train(texts: list[str], labels: list[int]) -> Network:
    """Fit on the texts; with one class only, every score is near that class's share, and with no text every
    score is 0.05, so that nothing is rejected."""
    raw, y = [(t or "").encode() for t in texts], np.array(labels, np.float32)
    prior = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if raw else float(np.log(0.05 / 0.95))
    plain, starts, end, hashes, bounds, spots = _split(raw or [b""])
    data = _codes(plain, 0, len(plain))
    seen, which = np.unique(hashes, return_inverse=True)
    total, toxic = _presence(which, bounds, y, len(seen))
    common = np.flatnonzero(total >= 3)
    common = np.sort(common[np.argsort(-total[common], kind="stable")[:VOCABULARY]])
    odds = _odds(total[common], toxic[common], prior)
    net = Network(seen[common], odds, _odds(*_presence(data, spots, y, GRAMS), prior), prior)
    if len(set(labels)) < 2:
        return net
    ids = net.word_ids(hashes)
    first, length, text = _windows(bounds)
    rng, p = np.random.default_rng(SEED), net.p
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    # Before the first round the window with the most telling word counts as the highest.
    each = np.concatenate([odds, [0]])[ids - 1] if len(common) else np.zeros(len(ids), np.float32)
    rank = np.maximum.reduceat(np.concatenate([each, [0]]).astype(np.float32), np.stack([first, first + length], 1).ravel())[::2]
    for epoch in range(EPOCHS):
        if epoch:
            for a in range(0, len(raw), 100):
                words, some = slice(bounds[a], bounds[min(a + 100, len(raw))]), slice(*np.searchsorted(text, [a, a + 100]))
                rank[some] = net.window_logits(net.inputs(plain, starts[words], end[words], ids[words]), first[some] - words.start, length[some])
        order = np.lexsort((rank, text))
        top = order[np.append(text[order][1:] != text[order][:-1], True)]
        top = rng.permutation(top)
        rate = RATE * (1 - epoch / EPOCHS)
        for at in range(0, len(top), BATCH):
            w = top[at : at + BATCH]
            steps = np.arange(WINDOW)[:, None]
            at_words = first[w] + np.minimum(steps, length[w] - 1)
            live = steps < length[w]
            flat = at_words.ravel()
            x = _inputs_of(net, data, starts[flat], end[flat], ids[flat])
            logit, state = net.forward(x.reshape(WINDOW, len(w), -1), live, keep=True)
            g, dx = net.backward(((_sigmoid(logit) - y[text[w]]) / len(w)).astype(np.float32), state)
            dx = dx.reshape(len(flat), -1)
            g["words"], g["chars"] = np.zeros_like(p["words"]), np.zeros_like(p["chars"])
            np.add.at(g["words"], ids[flat], dx[:, :WORD])
            size = end[flat] - starts[flat]
            span = np.repeat(starts[flat] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            np.add.at(g["chars"], data[span], np.repeat(dx[:, WORD:] / size[:, None].astype(np.float32), size, axis=0))
            step += 1
            for k, x in p.items():
                d = g[k] + np.float32(1e-4) * x
                m[k] += np.float32(0.1) * (d - m[k])
                v[k] += np.float32(0.01) * (d * d - v[k])
                x -= np.float32(rate) * (m[k] / np.float32(1 - 0.9**step)) / (np.sqrt(v[k] / np.float32(1 - 0.99**step)) + np.float32(1e-6))
    return net


def _inputs_of(net: Network, data: np.ndarray, first: np.ndarray, end: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """inputs() of words in any order."""
    size = end - first
    starts = np.cumsum(size) - size
    span = np.repeat(first - starts, size) + np.arange(size.sum())
    chars = np.add.reduceat(net.p["chars"][data[span]], starts, axis=0) / size[:, None].astype(np.float32)
    return np.concatenate([net.p["words"][ids], chars], axis=1)


def held_out(id_column: Column | str = "doc_id") -> Column:
    """The rows whose labels nothing learns from."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4 == 2 if isinstance(id_column, str) else F.crc32(id_column.cast("string").cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Train on at most SAMPLE_ROWS labelled rows of at most SAMPLE_CHARS characters, in the order of a hash of their id.

    One task reads the sample and trains; only the network, of a fixed size, comes to the driver. A lost
    executor means that the task runs again, with the same result. Labels that are null are left out; an id
    with several labels has a row for each.
    """
    prepare(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    picked = known.orderBy(F.xxhash64("id"), "id", "label").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(picked), "id")
    sample = rows.orderBy(F.xxhash64("id"), "id", "text", "label").limit(SAMPLE_ROWS).select("text", "label")

    def learn(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels_ = [], []
        for frame in frames:
            texts += frame.column(0).to_pylist()
            labels_ += frame.column(1).to_pylist()
        net = pickle.dumps(train(texts, labels_))
        del texts, labels_
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([net], pa.binary())], ["net"])

    made = sample.repartition(1).mapInArrow(learn, "net binary").collect()
    return pickle.loads(made[0].net) if made else train([], [])


def toxicity(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` with score (0 to 1) and predicted (1 from THRESHOLD up, else 0), over whole texts.

    Null, empty and wordless texts get the score of the sample's share of toxic rows. Columns of ``docs``
    with those names are replaced. Rows stay where they are; repeated rows get the same score. An empty table
    gives none.
    """
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(net)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for a, b in spans(frame.column(at)):
                part = frame.slice(a, b - a)
                scores = shared.value.scores(part.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], names)
        frame = part = None
        trim()

    plain = docs.drop("score", "predicted")
    at, schema = plain.columns.index(text_col), plain.drop("score").schema.add("score", "double")
    names = schema.fieldNames()
    return plain.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")
