"""Language-model scoring (11): a probabilistic suffix tree over words.

Symbols are the words of a text, lower-cased, and one end. A state is a context of up to ``depth`` words before a
symbol. All phrases are counted exactly, also those that occur once: no count or share decides what is in the tree.

1. A context's distribution is smoothed with the one of its suffix: a symbol x seen after s has
   (c(sx) - D) / c(s) + b(s) P(x | suffix), another b(s) P(x | suffix), where b(s) is the mass that these leave. A
   context is retained if the divergence of its distribution from its suffix's, times its occurrences, exceeds what its
   parameters cost (half the logarithm of c(s) for each symbol, and one more). A symbol is scored in the longest
   retained context that precedes it. The root is the base: (c + ALPHA) / (N + ALPHA (V + 1)).
2. Crowded contexts (of CROWD_MOST occurrences at the latest, so that a task can hold those of any other) are few of
   each length, and are solved level by level by joins.
3. Every other symbol is sent, once, to the bucket of the shortest context before it that isn't crowded. There all
   occurrences of that context, and so of all that end with it, meet, and their distributions are exact. Buckets have
   about BUCKET symbols whatever the corpus, and are solved one at a time.
4. What a bucket starts from, the probability after the longest crowded context (the root at least), is broadcast for
   words of a share of FREQUENT of the tokens or more, and for phrases after crowded contexts, at most the most frequent
   ENTRIES of each length. Buckets ask for the rest by a join on hashes. As the words' bound is a share of the tokens,
   what is asked is in proportion to the corpus; where all words and phrases are broadcast, nothing is.
5. A task sums up what its buckets add to each row, and sends that packed to the row's chunk, where lines are completed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import textbytes as tb
from .pretoken import spans
from .shared import prepare, removed, stored, table, trim

#: Words of the longest context; share of the training tokens, and least count, from which a phrase counts: all do.
DEPTH, SHARE, FEWEST = 3, 0.0, 1
#: Discount of a seen symbol, and what the base adds to each count.
DISCOUNT, ALPHA = 0.6, 0.1
#: Share of the training tokens from which a context is crowded, where that is between these counts.
CROWD_SHARE, CROWD_LEAST, CROWD_MOST = 1 / 250, 50_000, 1_000_000
#: Training tokens of a bucket; symbols of a packed chunk.
BUCKET, CHUNK = 500_000, 500_000
#: Share of the training tokens from which all tasks have a word; most words, and phrases of each length after crowded
#: contexts, that they have.
FREQUENT, ENTRIES = 1 / 20_000_000, 2_000_000
#: Words, or phrases, that a task sums up at once, and hashes of words that it holds.
AT_ONCE, HELD = 2_000_000, 2_000_000

#: The end's hash, of a word that no text has.
END = np.uint64(0x5851F42D4C957F2D)
_STEP = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(16)]


def symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' symbols on end, an end after each text's words; where each text's start (one more)."""
    _, _, hashes, bounds = tb.words(*tb.join_texts(texts))
    n = len(texts)
    out = np.empty(len(hashes) + n, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(hashes)) + owner] = hashes
    starts = bounds + np.arange(n + 1)
    out[starts[1:] - 1] = END
    return out, starts


def before(starts: np.ndarray) -> np.ndarray:
    """Of each symbol, how many precede it in its text."""
    return np.arange(starts[-1]) - np.repeat(starts[:-1], np.diff(starts))


def last_words(hashes: np.ndarray, k: int, at: np.ndarray | None = None) -> np.ndarray:
    """The hash of the ``k`` symbols up to each of ``at``, which have k - 1 before them. It is made from the last one
    back, so that one of k + 1 symbols extends it; one symbol's hash is its own."""
    at = np.arange(k - 1, len(hashes)) if at is None else at
    out = hashes[at]
    for j in range(1, k):
        out = tb.mix(out ^ tb.mix(hashes[at - j] + _STEP[j]))
    return out


def _parts(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for frame in frames:
        for a, b in spans(frame.column(column)):
            part = frame.slice(a, b - a)
            yield part, *symbols([(t or "").encode() for t in part.column(column).to_pylist()])
    trim()


def _summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = np.sort(keys)
    begin = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[begin], np.diff(np.append(begin, len(keys)))


class _Sums:
    """Counts of keys that a task gathers."""

    def __init__(self):
        self.keys, self.counts, self.raw, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether there are so many that they should go out."""
        self.raw.append(keys)
        self.n += len(keys)
        if self.n > AT_ONCE:
            self.fold()
        return len(self.keys) > HELD

    def fold(self) -> None:
        keys, counts = _summed(np.concatenate([np.zeros(0, np.uint64), *self.raw]))
        both, n = np.concatenate([self.keys, keys]), np.concatenate([self.counts, counts])
        order = np.argsort(both, kind="stable")
        both, n = both[order], n[order]
        begin = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
        self.keys, self.counts = both[begin], np.add.reduceat(n, begin) if len(begin) else n
        self.raw, self.n = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.fold()
        out, self.keys, self.counts = (self.keys, self.counts), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v) for v in columns.values()], [*columns])


def _word_counts(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums = _Sums()
    for _, hashes, _ in _parts(frames, 0):
        if sums.add(hashes):
            keys, n = sums.take()
            yield _batch(word=keys, n=n)
    keys, n = sums.take()
    yield _batch(word=keys, n=n)


def _phrase_counts(crowded: Broadcast, k: int):
    """(phrase, context, inner, n): phrases of k symbols after crowded contexts; their first k - 1 and last k - 1."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, seen = _Sums(), []

        def out():
            keys, n = sums.take()
            known, where = np.unique(np.concatenate([x[0] for x in seen]), return_index=True) if seen else (keys, keys)
            parts = [np.concatenate([x[j] for x in seen])[where] if seen else keys for j in (1, 2)]
            seen.clear()
            assert len(known) == len(keys)
            return _batch(phrase=keys, context=parts[0], inner=parts[1], n=n)

        for _, hashes, starts in _parts(frames, 0):
            at = np.flatnonzero(before(starts) >= k - 1)
            at = at[_found(last_words(hashes, k - 1, at - 1), crowded.value)[1]]
            keys = last_words(hashes, k, at)
            distinct, one = np.unique(keys, return_index=True)
            seen.append((distinct, last_words(hashes, k - 1, at[one] - 1), last_words(hashes, k - 1, at[one])))
            if len(seen) > 8:  # one entry of each phrase
                joined = [np.concatenate([x[j] for x in seen]) for j in range(3)]
                _, one = np.unique(joined[0], return_index=True)
                seen[:] = [tuple(x[one] for x in joined)]
            if sums.add(keys):
                yield out()
        yield out()

    return run


@dataclass
class Tree:
    """What all tasks have, hashes in order: the most frequent words, their counts and ranks from 1 on, of crowded
    contexts of k words B(s), and the probability of the most frequent phrases that end one symbol after such a one;
    whether these are all words, and all phrases of each length."""

    words: np.ndarray
    counts: np.ndarray
    ranks: np.ndarray
    crowded: list[tuple[np.ndarray, np.ndarray]]
    phrases: list[tuple[np.ndarray, np.ndarray]]
    whole: list[bool]
    depth: int
    fewest: int
    n: int
    v: int

    @property
    def mass(self) -> float:
        return self.n + ALPHA * (self.v + 1)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order of their first occurrences, and of each key its place among them."""
    coded = pa.array(keys).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def _found(keys: np.ndarray, table_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key its place in a sorted table, and whether it is there."""
    if len(table_) > 10_000 and len(keys) > 10_000:  # a large table isn't in the processor's cache
        keys, own = _distinct(keys)
        at = np.minimum(np.searchsorted(table_, keys), len(table_) - 1)
        return at[own], (table_[at] == keys)[own]
    at = np.minimum(np.searchsorted(table_, keys), max(0, len(table_) - 1))
    return at, table_[at] == keys if len(table_) else np.zeros(len(keys), bool)


def _sorted(rows: pa.Table, key: str, value: str) -> tuple[np.ndarray, np.ndarray]:
    keys, values = rows[key].to_numpy().view(np.uint64), rows[value].to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]


def _most(rows: DataFrame, key: str, value: str, entries: int, least: int = 1) -> tuple[tuple[np.ndarray, np.ndarray], DataFrame | None]:
    """The entries of the most frequent rows (n), from ``least`` on and at most so many, all or none of a count; and the
    other rows, to be joined, if there are any."""
    held, bound = 0, None
    for r in rows.where(F.col("n") >= least).groupBy("n").agg(F.count("*").alias("rows")).orderBy(F.desc("n")).limit(entries).collect():
        if held + r.rows > entries:
            break
        held, bound = held + r.rows, r.n
    often = F.col("n") >= bound if bound is not None else F.lit(False)
    return _sorted(rows.where(often).select(key, value).toArrow(), key, value), rows.where(~often) if held < rows.count() else None


def fit(texts: DataFrame, depth: int = DEPTH, share: float = SHARE, fewest: int = FEWEST, crowd: int | None = None, entries: int = ENTRIES) -> tuple[Tree, DataFrame | None]:
    """What all tasks have, and what symbols have before contexts that aren't crowded where the tasks don't have it
    (key, p), to be joined: words are 64-bit hashes.

    A null or empty text is an end alone; without texts the tree is empty. Rows that repeat count again.
    """
    spark = prepare(texts.sparkSession)
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))
    words = stored(texts.mapInArrow(_word_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = total.n or 0, total.v
    mass, fewest = n + ALPHA * (v + 1), max(fewest, math.ceil(share * n))
    crowd = crowd or min(max(CROWD_LEAST, math.ceil(CROWD_SHARE * n)), CROWD_MOST)
    # (phrase, n, p): how often, and the probability of its last symbol after the others.
    shorter = words.select(F.col("word").alias("phrase"), "n", ((F.col("n") + ALPHA) / mass).alias("p"))
    empty = (np.zeros(0, np.uint64), np.zeros(0))
    (most, counts), rest = _most(words.withColumn("m", F.col("n")), "word", "m", entries, max(1, math.ceil(FREQUENT * n)))
    others, whole = [rest.select(F.col("word").alias("key"), ((F.col("n") + ALPHA) / mass).alias("p"))] if rest else [], [not rest]
    crowded, kept = [], []
    for k in range(2, depth + 2):
        contexts = shorter.where(F.col("n") >= crowd).select(F.col("phrase").alias("context"), F.col("n").alias("c"))
        wide, _ = _sorted(contexts.toArrow(), "context", "c")  # n / crowd at most
        if not len(wide):
            crowded, kept, whole = (x + [y] * (depth + 2 - k) for x, y in ((crowded, empty), (kept, empty), (whole, True)))
            break
        sent = spark.sparkContext.broadcast(wide)
        counted = texts.mapInArrow(_phrase_counts(sent, k), "phrase long, context long, inner long, n long").groupBy("phrase").agg(F.first("context").alias("context"), F.first("inner").alias("inner"), F.sum("n").alias("n"))
        rows = counted.join(F.broadcast(contexts), "context").join(shorter.select(F.col("phrase").alias("inner"), "p"), "inner")
        rows = stored(rows.select("phrase", "context", "n", "c", "p"), "phrases")
        sent.unpersist()
        often = F.col("n") >= fewest
        left = rows.where(often).groupBy("context").agg(F.count("*").alias("seen"), (1 - (F.sum("n") - DISCOUNT * F.count("*")) / F.max("c")).alias("b"))
        q = F.when(often, (F.col("n") - DISCOUNT) / F.col("c")).otherwise(0.0) + F.col("b") * F.col("p")
        smooth = rows.join(F.broadcast(left), "context").withColumn("q", q)
        gain = F.sum(F.col("n") * F.log(F.col("q") / F.col("p"))) + (F.max("c") - F.sum("n")) * F.log(F.max("b"))
        held = smooth.where(often).groupBy("context").agg(gain.alias("gain"), F.max("c").alias("c"), F.max("seen").alias("seen"), F.max("b").alias("b"))
        held = stored(held.withColumn("b", F.when(F.col("gain") > 0.5 * F.log("c") * (F.col("seen") + 1), F.col("b"))).select("context", "b"), "states")
        tried = rows.join(F.broadcast(held), "context", "left").withColumn("q", F.coalesce(q, "p"))
        shorter = stored(tried.select("phrase", "n", F.col("q").alias("p")), "level")
        removed(rows)
        known = dict(zip(*_sorted(held.where("b is not null").toArrow(), "context", "b"), strict=True))
        crowded.append((wide, np.array([known.get(s, 1.0) for s in wide])))
        held, rest = _most(shorter, "phrase", "p", entries)
        kept.append(held)
        whole.append(not rest)
        others += [rest.select(F.col("phrase").alias("key"), "p")] if rest else []
    ranks = np.empty(len(most), np.uint32)
    ranks[np.argsort(-counts, kind="stable")] = np.arange(1, len(most) + 1)
    return Tree(most, counts, ranks, crowded, kept, whole, depth, fewest, n, v), reduce(DataFrame.unionByName, others) if others else None


def chained(columns: list[np.ndarray], k: int) -> np.ndarray:
    """``last_words`` of k symbols by columns: the last symbols, those before them and so on."""
    out = columns[0]
    for j in range(1, k):
        out = tb.mix(out ^ tb.mix(columns[j] + _STEP[j]))
    return out


def _narrow(t: Tree, columns: list[np.ndarray], place: np.ndarray) -> np.ndarray:
    """Of each symbol, how many words the longest crowded context before it has."""
    out = np.zeros(len(place), np.uint8)
    for k in range(1, t.depth + 1):
        where = np.flatnonzero((out == k - 1) & (place >= k))
        if not len(where) or not len(t.crowded[k - 1][0]):
            break
        out[where[_found(chained([c[where] for c in columns[1:]], k), t.crowded[k - 1][0])[1]]] = k
    return out


def _after_crowded(t: Tree, column: Callable[[int, np.ndarray], np.ndarray], crowded: np.ndarray, p: np.ndarray, more: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """P of each symbol after its longest crowded context, from that of its word, ``p``; whether it is certain without
    ``more``, the (key, p) of rarer phrases; and the symbols whose keys ``more`` should have been asked for.
    ``column(k, where)`` are the hashes of the symbols k before these."""
    p, times, open_, sure, asked = p.copy(), np.ones(len(p)), crowded > 0, np.ones(len(p), bool), []
    for k in range(t.depth, 0, -1):
        where = np.flatnonzero(open_ & (crowded >= k))
        if not len(where):
            continue
        own = [column(j, where) for j in range(k + 1)]
        keys = chained(own, k + 1)
        table_, values = t.phrases[k - 1]
        at, hit = _found(keys, table_)
        value = np.zeros(len(where))
        value[hit] = values[at[hit]]
        if not t.whole[k]:
            sure[where[~hit]] = False
            asked.append((where[~hit], keys[~hit]))
            if more is not None and len(more[0]):
                at, found = _found(keys, more[0])
                value[found & ~hit] = more[1][at[found & ~hit]]
                hit = hit | found
        p[where[hit]], open_[where[hit]] = value[hit], False
        where, own = where[~hit], [c[~hit] for c in own]
        times[where] *= t.crowded[k - 1][1][_found(chained(own[1:], k), t.crowded[k - 1][0])[0]]
    return p * times, sure, asked


@dataclass
class _Chunk:
    """Some texts' symbols: how many of up to depth words precede each; distinct words, their places among the broadcast
    ones and whether they are there, and each symbol's among the distinct ones. Of the symbols ``at``: the bucket that
    each goes to, the words of its longest crowded context, P after it, whether that is all, and which it asks for."""

    place: np.ndarray
    words: np.ndarray
    found: np.ndarray
    known: np.ndarray
    ids: np.ndarray
    at: np.ndarray
    bucket: np.ndarray
    crowded: np.ndarray
    p: np.ndarray
    done: np.ndarray
    asked: list[tuple[np.ndarray, np.ndarray]]


def _chunk(t: Tree, hashes: np.ndarray, starts: np.ndarray, buckets: int, asking: bool = False) -> _Chunk:
    """``asking``: only the symbols that may ask."""
    place = np.minimum(before(starts), t.depth).astype(np.uint8)
    words, ids = _distinct(hashes)
    found, known = _found(words, t.words)
    at = np.arange(len(hashes))
    if asking:
        some = ~(known | t.whole[0])[ids]
        if not all(t.whole[1:]):
            some[1:] |= _found(words, t.crowded[0][0])[1][ids[:-1]] & (place[1:] > 0)
        at = np.flatnonzero(some)
    columns = [hashes[at], *(np.where(place[at] >= k, hashes[at - k], np.uint64(0)) for k in range(1, t.depth + 1))]
    crowded = _narrow(t, columns, place[at])
    root = np.full(len(words), ALPHA / t.mass)
    root[known] = (t.counts[found[known]] + ALPHA) / t.mass
    p, sure, asked = _after_crowded(t, lambda k, where: columns[k][where], crowded, root[ids[at]])
    if not t.whole[0]:
        rare = np.flatnonzero(~known[ids[at]])
        sure[rare] = False
        asked.append((rare, columns[0][rare]))
    full = crowded >= place[at]
    route = np.zeros(len(at), np.uint64)
    for k in range(t.depth + 1):
        where = np.flatnonzero((crowded == k) & full)
        route[where] = chained([c[where] for c in columns[: k + 1]], k + 1)
        where = np.flatnonzero((crowded == k) & ~full)
        route[where] = chained([c[where] for c in columns[1 : k + 2]], k + 1) if k < t.depth else 0
    bucket = ((tb.mix(route) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    return _Chunk(place, words, found, known, ids, at, bucket, crowded, p, full & sure, asked)


def _gathered(frames: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]]:
    """Parts of about CHUNK symbols."""
    parts, held, n = [], [], 0

    def out():
        ends = np.cumsum([0, *(len(h) for h, _ in held)])
        return parts, np.concatenate([h for h, _ in held]), np.concatenate([*(s[:-1] + e for (_, s), e in zip(held, ends[:-1], strict=True)), ends[-1:]])

    for part, hashes, starts in _parts(frames, column):
        parts.append(part)
        held.append((hashes, starts))
        n += len(hashes)
        if n >= CHUNK:
            yield out()
            parts, held, n = [], [], 0
    if parts:
        yield out()


def _asked(tree: Broadcast, buckets: int):
    """(key, bucket): which buckets need the probability of which rarer phrases."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, hashes, starts in _gathered(frames, 0):
            c = _chunk(tree.value, hashes, starts, buckets, asking=True)
            for where, keys in c.asked:
                where, keys = c.bucket[where], keys
                order = np.lexsort((where, keys))
                where, keys = where[order], keys[order]
                new = np.ones(len(keys), bool)
                new[1:] = (keys[1:] != keys[:-1]) | (where[1:] != where[:-1])
                yield _batch(key=keys[new], bucket=where[new].astype(np.int32))

    return run


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _packed(codes: list[np.ndarray], owners: np.ndarray, crowded: np.ndarray, rare: np.ndarray, first_rare: int) -> tuple[bytes, int]:
    """Symbols by their rank among the broadcast words, others by their place in a list of their own."""
    own = np.unique(np.concatenate([c[c >= first_rare] for c in codes]))
    out = []
    for c in codes:
        c = c.copy()
        some = c >= first_rare
        c[some] = first_rare + np.searchsorted(own, c[some])
        out.append(_planes(c))
    body = b"".join([np.array([len(owners), len(own)], "<u4").tobytes(), rare[own - first_rare].astype("<u8").tobytes(), *out, _planes(owners), crowded.tobytes()])
    return pa.Codec("zstd", compression_level=1).compress(body, asbytes=True), len(body)


def _unpacked(depth: int, body: bytes, size: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    body = pa.Codec("zstd").decompress(body, size, asbytes=True)
    n, rare = np.frombuffer(body, "<u4", 2).tolist()
    at = 8 + 8 * rare
    planes = [np.frombuffer(body, np.uint8, 4 * n, at + 4 * n * j).reshape(4, n).T.copy("C").view("<u4").ravel() for j in range(depth + 2)]
    return np.frombuffer(body, "<u8", rare, 8), planes[:-1], planes[-1], np.frombuffer(body, np.uint8, n, at + 4 * n * len(planes))


def _dealt(tree: Broadcast, buckets: int, schema: pa.Schema):
    """Each row's own line, with what is certain of it here, and its other symbols packed by bucket."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        for parts, hashes, starts in _gathered(frames, 3):
            rows = np.concatenate([part.column(0).to_numpy() for part in parts])
            c = _chunk(t, hashes, starts, buckets)
            # A word that isn't broadcast is added by its bucket, unless all are and it has no count.
            root = np.full(len(c.words), math.log10(ALPHA) if t.whole[0] else 0.0)
            root[c.known] = np.log10(t.counts[c.found[c.known]] + ALPHA)
            sure = np.where(c.done, np.log(c.p), 0.0)
            base, known, sure = (np.add.reduceat(x, starts[:-1]) for x in (root[c.ids], c.known[c.ids].astype(np.int64), sure))
            sizes = np.diff(starts)
            n = len(rows)
            ids, held_out = (pa.concat_arrays([part.column(j) for part in parts]) for j in (1, 2))
            doc = pa.StructArray.from_arrays([ids, held_out, *map(pa.array, (sizes, known, base))], fields=list(schema.field("doc").type))
            here = np.abs(rows % buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.full(n, 2, np.int32)), pa.array(rows), pa.nulls(n, pa.binary()), pa.array(np.full(n, rows[0])), pa.array(sure), doc], schema=schema)

            other = np.flatnonzero(~c.known)
            rare, code = c.words[other], np.empty(len(c.words), np.uint32)
            code[c.known] = t.ranks[c.found[c.known]]
            code[other] = len(t.words) + 1 + np.arange(len(other))
            before_ = [code[c.ids]]
            for k in range(1, t.depth + 1):
                column = np.zeros(len(hashes), np.uint32)
                column[k:] = before_[0][:-k]
                column[c.place < k] = 0
                before_.append(column)
            train = ~held_out.to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(n), sizes)
            owners = ((rows[owner] - rows[0]) * 2 + train[owner]).astype(np.uint32)
            left = np.flatnonzero(~c.done)
            alike = (before_[1][left].astype(np.uint64) << np.uint64(24)) | before_[min(2, t.depth)][left]
            left = left[np.argsort(c.bucket[left].astype(np.uint64) << np.uint64(48) | alike & np.uint64(2**48 - 1)) if buckets < 2**16 else np.lexsort((alike, c.bucket[left]))]
            edges = np.flatnonzero(np.diff(c.bucket[left], prepend=-1, append=-1))
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                some = left[a:b]
                body, size = _packed([x[some] for x in before_], owners[some], c.crowded[some], rare, len(t.words) + 1)
                out.append((int(c.bucket[some[0]]), 1, int(rows[0]), body, size))
            if out:
                columns = [pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), schema, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(out), pa.float64()), pa.nulls(len(out), schema.field("doc").type)], schema=schema)

    return run


def _climbed(t: Tree, codes: list[np.ndarray], place: np.ndarray, crowded: np.ndarray, train: np.ndarray, p: np.ndarray) -> np.ndarray:
    """P of each symbol after its longest retained context, from that after its longest crowded one. All occurrences
    of a context that isn't crowded are here, so that its distribution is exact. Words are numbers of this bucket."""
    p, pair = p.copy(), lambda a, b: a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
    before_ = codes[1] if t.depth else None
    for k in range(1, t.depth + 1):
        if k > 1:
            before_ = _distinct(pair(before_, codes[k]))[1]
        where = np.flatnonzero((crowded < k) & (place >= k))
        if not len(where):
            continue
        _, phrase = _distinct(pair(before_[where], codes[0][where]))
        one = np.flatnonzero(np.diff(np.maximum.accumulate(phrase), prepend=-1))
        n = np.bincount(phrase, train[where], len(one))
        _, context = _distinct(before_[where[one]])
        low, often = p[where[one]], (n > 0) & (n >= t.fewest)
        summed = lambda x: np.bincount(context, x)  # noqa: E731, B023
        c, seen, of_seen = summed(n), summed(often * 1.0), summed(n * often)
        b = 1 - (of_seen - DISCOUNT * seen) / np.maximum(c, 1)
        q = np.where(often, (n - DISCOUNT) / np.maximum(c[context], 1), 0.0) + b[context] * low
        gain = summed(np.where(often, n * np.log(q / low), 0.0)) + (c - of_seen) * np.log(b)
        retained = (seen > 0) & (gain > 0.5 * np.log(np.maximum(c, 1)) * (seen + 1))
        p[where] = np.where(retained[context], q, low)[phrase]
    return p


def _packed_sums(rows: np.ndarray, ln: np.ndarray, base: np.ndarray, found: np.ndarray) -> tuple[bytes, int]:
    """Sums of rows in order, counted from the chunk's first."""
    some = np.flatnonzero((base != 0) | (found > 0))
    body = b"".join([np.array([len(rows), len(some)], "<u4").tobytes(), ln.astype("<f8").tobytes(), base[some].astype("<f8").tobytes(), *map(_planes, (np.diff(rows, prepend=0), some, found[some].round()))])
    return pa.Codec("zstd", compression_level=1).compress(body, asbytes=True), len(body)


def _unpacked_sums(body: bytes, size: int) -> list[np.ndarray]:
    """Rows, ln; rows with words that aren't broadcast, what these add to the base, how many are known."""
    body = pa.Codec("zstd").decompress(body, size, asbytes=True)
    n, m = np.frombuffer(body, "<u4", 2).tolist()
    plane = lambda k, at: np.frombuffer(body, np.uint8, 4 * k, at).reshape(4, k).T.copy("C").view("<u4").ravel().astype(np.int64)
    at = 8 + 8 * (n + m)
    rows = np.cumsum(plane(n, at))
    return [rows, np.frombuffer(body, "<f8", n, 8), rows[plane(m, at + 4 * n)], np.frombuffer(body, "<f8", m, 8 + 8 * n), plane(m, at + 4 * (n + m))]


def _lined(schema: pa.Schema):
    """The lines of each chunk's rows with all that its buckets add."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            part = pa.concat_batches(held)
            lines = part.filter(part.column("doc").is_valid()).sort_by("row")
            doc = lines.column("doc")
            id_, held_out, n_tokens, n_known, base = (doc.field(j) for j in range(5))
            rows, ln, base, n_known = lines.column("row").to_numpy() - now, *(x.to_numpy().copy() for x in (lines.column("ln"), base, n_known))
            sums = part.filter(part.column("body").is_valid())
            for body, size in zip(sums.column("body").to_pylist(), sums.column("size").to_pylist(), strict=True):
                own, add, some, more, found = _unpacked_sums(body, size)
                ln[np.searchsorted(rows, own)] += add
                at = np.searchsorted(rows, some)
                base[at] += more
                n_known[at] += found
            return pa.RecordBatch.from_arrays([id_, held_out, n_tokens, *map(pa.array, (n_known, base, ln))], schema=schema)

        for frame in frames:
            chunk = frame.column(0).to_numpy()
            edges = np.append(np.flatnonzero(np.diff(chunk, prepend=-1)), len(chunk))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if chunk[a] != now and held:
                    yield out()
                    held.clear()
                now = int(chunk[a])
                held.append(frame.slice(a, b - a))
        if held:
            yield out()

    return run


def _solved(tree: Broadcast, schema: pa.Schema):
    """(chunk, row, ln, doc, body, size): rows' own lines pass; what the buckets of a task, one after the other, add to the
    rows of a chunk, of words that aren't broadcast also to their base and their known words, goes out packed by chunk."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t: Tree = tree.value
        known, root = np.zeros(len(t.words) + 1, np.uint64), np.zeros(len(t.words) + 1)  # by rank
        known[t.ranks], root[t.ranks] = t.words, (t.counts + ALPHA) / t.mass
        now, keys, values, bodies, sums, n, chunks = None, [], [], [], [], 0, set()

        def solve():
            held = [_unpacked(t.depth, body, size) for _, body, size in bodies]
            rare, own = _distinct(np.concatenate([h[0] for h in held]))
            # Each body's list of rarer words in the numbers of this bucket.
            first, codes = 0, []
            for h in held:
                for c in h[1]:
                    some = c >= len(known)
                    c[some] = len(known) + own[first + c[some].astype(np.int64) - len(known)]
                codes.append(h[1])
                first += len(h[0])
            codes = [np.concatenate([c[k] for c in codes]) for k in range(t.depth + 1)]
            owners, crowded = (np.concatenate([h[j] for h in held]) for j in (2, 3))
            place = sum(((c > 0).astype(np.uint8) for c in codes[1:]), np.zeros(len(owners), np.uint8))
            rows = np.concatenate([row + (h[2] >> 1).astype(np.int64) for (row, _, _), h in zip(bodies, held, strict=True)])
            chunks.update(row for row, _, _ in bodies)
            held.clear()
            more = np.concatenate([np.zeros(0, np.int64), *keys]).view(np.uint64), np.concatenate([np.zeros(0), *values])
            order = np.argsort(more[0])
            more = more[0][order], more[1][order]
            at, counted = _found(rare, more[0])
            p_rare = np.full(len(rare), ALPHA / t.mass)
            p_rare[counted] = more[1][at[counted]]
            names, start = np.concatenate([known, rare]), np.concatenate([root, p_rare])[codes[0]]
            p, _, _ = _after_crowded(t, lambda k, where: names[codes[k][where]], crowded, start, more)
            ln = np.log(_climbed(t, codes, place, crowded, (owners & 1).astype(float), p))
            some = codes[0] >= len(known) if not t.whole[0] else np.zeros(len(ln), bool)
            base, found = np.zeros(len(ln)), np.zeros(len(ln))
            base[some], found[some] = np.log10(start[some] * t.mass), counted[codes[0][some] - np.uint32(len(known))]
            return summed(rows, ln, base, found)

        def summed(rows, *columns):
            rows, where = _distinct(rows)
            return rows, *(np.bincount(where, x, len(rows)) for x in columns)

        def folded():
            return summed(*(np.concatenate([x[j] for x in sums]) for j in range(4)))

        def packed(rows, *columns):
            order, begin = np.argsort(rows), np.sort(np.array([*chunks], np.int64))
            rows, columns = rows[order], [x[order] for x in columns]
            edges = np.append(np.searchsorted(rows, begin), len(rows))
            out = [(int(c), *_packed_sums(rows[a:b] - c, *(x[a:b] for x in columns))) for c, a, b in zip(begin, edges[:-1], edges[1:], strict=True)]
            chunks.clear()
            m = len(out)
            c, body, size = (pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.int64()), strict=True))
            return pa.RecordBatch.from_arrays([c, pa.nulls(m, pa.int64()), pa.nulls(m, pa.float64()), pa.nulls(m, schema.field("doc").type), body, size], schema=schema)

        for frame in frames:
            bucket, kind = frame.column(0).to_numpy(), frame.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(bucket * 4 + kind, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if bucket[a] != now:
                    if bodies:
                        sums.append(solve())
                        n += len(sums[-1][0])
                        if n > AT_ONCE:
                            sums = [folded()]
                            n = len(sums[0][0])
                            if n > HELD:
                                yield packed(*sums[0])
                                sums, n = [], 0
                    now, keys, values, bodies = bucket[a], [], [], []
                part = frame.slice(a, b - a)
                if kind[a] == 0:
                    keys.append(part.column(4).to_numpy())
                    values.append(part.column(5).to_numpy())
                elif kind[a] == 1:
                    bodies += zip(part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_pylist(), strict=True)
                else:
                    m = len(part)
                    yield pa.RecordBatch.from_arrays([*map(part.column, (4, 2, 5, 6)), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int64())], schema=schema)
        if bodies:
            sums.append(solve())
        if sums:
            yield packed(*folded())
        trim()

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 10, depth: int = DEPTH, share: float = SHARE, fewest: int = FEWEST, crowd: int | None = None, entries: int = ENTRIES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score): a row for each of ``docs``.

    Rows whose crc32 of the id as text is divisible by ``every`` are held out, the others are learned from; a null id
    counts as an empty text, whose crc32 is 0. A null or empty text is its end alone. Rows that repeat are scored, and
    learned from, as often as they occur. A text of any length is taken whole. Other columns of ``docs`` don't matter.
    An empty table gives none; without training rows every token has the same probability. Scores are logarithms to
    base 10. Words are told apart by 64-bit hashes. ``share`` above 0 makes a smaller model that leaves out phrases
    of a lesser share of the training tokens; ``crowd`` and ``entries`` only say how the work is dealt.
    """
    spark = prepare(docs.sparkSession)
    held_out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % every == 0).alias("held_out")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), held_out, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    tree, base = fit(rows.where(~F.col("held_out")).select("text"), depth, share, fewest, crowd, entries)
    sent = spark.sparkContext.broadcast(tree)
    buckets = 1 + tree.n // BUCKET
    line = StructType().add("id", docs.schema[id_col].dataType).add("held_out", "boolean").add("n_tokens", "long").add("n_known", "long").add("base", "double")
    dealt = StructType().add("bucket", "integer").add("kind", "integer").add("row", "long").add("body", "binary").add("key", "long").add("p", "double").add("doc", line)
    solved = StructType().add("chunk", "long").add("row", "long").add("ln", "double").add("doc", line).add("body", "binary").add("size", "long")
    lined = StructType([*line.fields]).add("ln", "double")
    met = rows.mapInArrow(_dealt(sent, buckets, to_arrow_schema(dealt)), dealt)
    if base is not None:
        asked = rows.select("text").mapInArrow(_asked(sent, buckets), "key long, bucket int")
        met = met.unionByName(asked.repartition("key").distinct().join(base, "key").withColumn("kind", F.lit(0)), allowMissingColumns=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    done = met.select(*dealt.names).mapInArrow(_solved(sent, to_arrow_schema(solved)), solved)
    # A line and its chunk's sums meet by chunk; chunks and tasks have one row of sums, however many rows these hold.
    lines = stored(done.repartition(parts, "chunk").sortWithinPartitions("chunk").mapInArrow(_lined(to_arrow_schema(lined)), lined), "scored")
    return lines.select(
        F.col("id").alias(id_col),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tree.n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(math.log10(tree.mass))).alias("base_score"),
        (F.col("ln") / math.log(10)).alias("score"),
    )


def op11_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
