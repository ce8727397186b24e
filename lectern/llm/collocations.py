"""Phrase collocations (13): frequent phrases by merged count-min sketches and an exact second pass, then scores.

1. Every task counts the 64-bit hashes of its words and pairs of words in a count-min sketch; sketches are merged by
   blocks of counters. A counter is never below a phrase's count, so no phrase of at least ``least`` is lost. As no
   phrase is more frequent than the pairs inside it, a second sketch counts the longer phrases whose pairs may all
   be frequent.
2. A last pass over the texts keeps the occurrences of phrases whose counters reach ``least``, sums them up in the
   task, and Spark sums up the (lang, phrase) rows of all tasks exactly.
3. A part of a candidate is at least as frequent as the whole, so its count is there too: from the shortest on, each
   phrase takes the counts of its first and last parts from the two phrases one word shorter. From the longest on,
   each tells those two the largest frequency around them. The best of each language are found in two steps.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sketch
from . import textbytes as tb
from .pretoken import binaries, stretches
from .shared import dealt_join, prepare, stored, table, trim

LONGEST, LEAST, TOP, PERCENT = 4, 30, 2000, 80
#: What ends a piece, and what parts the words of one.
ENDS = np.zeros(256, bool)
ENDS[[0x2E, 0x2C, 0x3B, 0x3A, 0x21, 0x3F, *range(0x0A, 0x0E)]] = True
BREAKS = ENDS.copy()
BREAKS[[0x20, 0x09]] = True
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")

#: Bytes of text that are taken at once; a piece is never cut.
SLICE = 1_000_000
#: Phrases whose counts a task holds before it passes them on, and occurrences that it sums up at once.
HELD, AT_ONCE = 1_000_000, 2_000_000
#: Bytes of text for each counter of a sketch, where its width isn't given.
BYTES_EACH = 32
TASK_BYTES = 128_000_000
#: Parts of a language in the first of the two steps to its best phrases.
SALTS = 64

_STEP = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64) for k in range(LONGEST)]
_CHECK = [np.uint64((0xD6E8FEB86659FD93 * (2 * k + 3) % 2**64) | 1) for k in range(LONGEST)]


def slices(texts: Iterator[tuple[bytes, int]], most: int = SLICE) -> Iterator[tuple[list[bytes], list[int]]]:
    """(texts, codes) of about ``most`` bytes; a longer text is cut where a piece ends."""
    held, codes, size = [], [], 0
    for text, code in texts:
        at = 0
        while at < len(text) or (at == 0 and not text):
            end = len(text)
            if end - at > most:
                m = _END.search(text, at + most)
                end = m.end() if m else end
            if size and size + end - at > most:
                yield held, codes
                held, codes, size = [], [], 0
            held.append(text[at:end])
            codes.append(code)
            size += end - at
            if not text:
                break
            at = end
    if held:
        yield held, codes


class Slice:
    """The words of some texts, and the hashes of their phrases."""

    def __init__(self, texts: list[bytes], codes: np.ndarray, seeds: np.ndarray):
        data, starts = tb.join_texts(texts)
        self.data, (self.first, self.end, self.hashes, bounds) = data, tb.words(data, starts, BREAKS)
        owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
        self.code = codes[owner]
        self.seed = seeds[self.code]
        self.piece = np.cumsum(ENDS[data], dtype=np.int64)[self.first] + owner if len(owner) else owner

    def phrases(self, longest: int, pairs: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(number of words, hashes, first words) of the phrases in each number of words; of more than two words,
        those whose pairs may all be frequent by the bits of ``pairs``."""
        n = len(self.hashes)
        rolled = self.seed.copy()
        for k in range(1, longest + 1):
            if n < k:
                return
            rolled = rolled[: n - k + 1] + tb.mix(self.hashes[k - 1 :] + _STEP[k - 1])
            inside = self.piece[: n - k + 1] == self.piece[k - 1 :]
            if k > 2 and pairs is not None:
                inside = frequent[: n - k + 1] & frequent[k - 2 :] & (frequent[1 : n - k + 2] if k > 3 else True)
            at = np.flatnonzero(inside)
            keys = tb.mix(rolled[at] + np.uint64(k))
            if k == 2 and pairs is not None:
                frequent = np.zeros(n - 1, bool)
                frequent[at] = sketch.may_be_heavy(keys, pairs)
            yield k, keys, at

    def check(self, k: int, at: np.ndarray) -> np.ndarray:
        """A second hash of phrases, independent of the first one's steps."""
        out = self.code[at].astype(np.uint64)
        for j in range(k):
            out = out * np.uint64(0xFF51AFD7ED558CCD) + tb.mix(self.hashes[at + j] * _CHECK[j])
        return out

    def written(self, k: int, at: np.ndarray) -> pa.Array:
        """Phrases with one blank between words."""
        length = np.zeros(len(at), np.int64)
        for j in range(k):
            length += self.end[at + j] - self.first[at + j] + (j > 0)
        rows = len(at) * k
        words = (at[:, None] + np.arange(k)).ravel()
        sizes = self.end[words] - self.first[words]
        # A word and the byte after it, which becomes the blank; the last word's is dropped.
        more = np.tile(np.arange(k) < k - 1, len(at)) if rows else np.zeros(0, bool)
        data = stretches(self.data, self.first[words], sizes + more)
        blanks = (np.cumsum(sizes + more) - 1)[more]
        data[blanks] = 0x20
        return binaries(data, np.concatenate([[0], np.cumsum(length)])).cast(pa.string())


def _texts(frame: pa.RecordBatch, langs: dict[str, int]) -> Iterator[tuple[bytes, int]]:
    for lang, text in zip(frame.column(0), frame.column(1), strict=True):
        code = langs.setdefault(lang.as_py() or "", len(langs))
        yield (text.as_buffer().to_pybytes() if text.is_valid else b""), code


def _seeds(langs: dict[str, int]) -> np.ndarray:
    raw = [x.encode() for x in langs]
    return np.array([int.from_bytes(blake2b(x, digest_size=8).digest(), "little") for x in raw], np.uint64)


def _slices(frames: Iterator[pa.RecordBatch], langs: dict[str, int]) -> Iterator[Slice]:
    for frame in frames:
        for texts, codes in slices(_texts(frame, langs)):
            yield Slice(texts, np.array(codes, np.int64), _seeds(langs))


def _sketched(width: int, longest: int, pairs: Broadcast | None = None):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.Sketcher(width)
        for part in _slices(frames, {}):
            for k, keys, _ in part.phrases(longest, pairs.value if pairs else None):
                if k > 2 or not pairs:
                    yield from counts.add(keys)
        yield from counts.rows()
        trim()

    return run


class _Tally:
    """Counts of (lang, phrase) rows that a task gathers before it passes them on."""

    def __init__(self):
        self.tables: list[pa.Table] = []
        self.rows = 0

    def add(self, got: pa.Table) -> Iterator[pa.RecordBatch]:
        self.tables.append(got)
        self.rows += got.num_rows
        if self.rows > 2 * HELD:
            self.fold()
            if self.rows > HELD:
                yield from self.flush()

    def fold(self) -> None:
        whole = pa.concat_tables(self.tables)
        got = whole.group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("n", "sum")]).select(["lang", "phrase", "words", "n_sum"]).rename_columns(["lang", "phrase", "words", "n"])
        self.tables, self.rows = [got], got.num_rows

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.tables:
            self.fold()
            yield from self.tables[0].combine_chunks().to_batches(max_chunksize=100_000)
        self.tables, self.rows = [], 0


def _summed(part: Slice, k: int, keys: np.ndarray, at: np.ndarray, names: np.ndarray) -> pa.Table:
    """The (lang, phrase) counts of some occurrences: grouped by hash, held against a second one."""
    check = part.check(k, at)
    order = np.argsort(keys, kind="stable")
    keys, check, at = keys[order], check[order], at[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (check[1:] != check[:-1])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(keys)))
    at = at[begin]
    return pa.table({"lang": pa.array(names[part.code[at]], pa.string()), "phrase": part.written(k, at), "words": pa.array(np.full(len(at), k, np.int32)), "n": pa.array(n)})


def _survivors(pairs: Broadcast, bits: Broadcast, longest: int):
    """(lang, phrase, words, n) of a task's phrases that may be frequent; a language's words in all have no phrase."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, langs, totals = _Tally(), {}, {}
        for part in _slices(frames, langs):
            names = np.array([*langs], object)
            for code, n in zip(*np.unique(part.code, return_counts=True), strict=True):
                totals[names[code]] = totals.get(names[code], 0) + int(n)
            for k, keys, at in part.phrases(longest, pairs.value):
                some = np.flatnonzero(sketch.may_be_heavy(keys, (bits if k > 2 else pairs).value))
                for a in range(0, len(some), AT_ONCE):
                    yield from tally.add(_summed(part, k, keys[some[a : a + AT_ONCE]], at[some[a : a + AT_ONCE]], names))
        yield from tally.flush()
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array([*totals], pa.string()), pa.array([None] * len(totals), pa.string()), pa.array([0] * len(totals), pa.int32()), pa.array([*totals.values()], pa.int64())], ["lang", "phrase", "words", "n"])
        trim()

    return run


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, longest: int = LONGEST, width: int | None = None) -> DataFrame:
    """(lang, phrase, words, n): all phrases of up to ``longest`` words with at least ``least`` occurrences within
    pieces, and for each language a row without phrase that counts all its words."""
    spark = prepare(docs.sparkSession)
    size = sketch.text_bytes(docs, text_col)
    # The longer a task, the fewer times a phrase is sent: a few tasks a core, or TASK_BYTES each of a large table.
    tasks = max(3 * spark.sparkContext.defaultParallelism, size // TASK_BYTES)
    texts = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).coalesce(tasks)
    width = width or sketch.width_for(size, each=BYTES_EACH)
    pairs = sketch.heavy_counters(texts.mapInArrow(_sketched(width, min(longest, 2)), sketch.SCHEMA), width, least)
    bits = sketch.heavy_counters(texts.mapInArrow(_sketched(width, longest, pairs), sketch.SCHEMA), width, least)
    counted = texts.mapInArrow(_survivors(pairs, bits, longest), "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("n"))
    return stored(counted.where(F.col("phrase").isNull() | (F.col("n") >= least)), "phrases")


def _levels(phrases: DataFrame, longest: int) -> list[DataFrame]:
    """For each number of words (lang, phrase, n, pre, suf, lefts, rights): the phrase without its last and first word,
    and the frequencies of its first 1, 2, .. words and of its last 1, 2, .. words, itself the last of both.

    A phrase takes them from the two phrases one word shorter, so it is looked up twice however many cuts it has."""
    own = phrases.withColumn("pre", F.regexp_replace("phrase", " [^ ]+$", "")).withColumn("suf", F.regexp_replace("phrase", "^[^ ]+ ", ""))
    out = [own.where("words = 1").select("lang", "phrase", "n", "pre", "suf", F.array("n").alias("lefts"), F.array("n").alias("rights"))]
    for k in range(2, longest + 1):
        first = out[-1].select("lang", F.col("phrase").alias("pre"), "lefts")
        last = out[-1].select("lang", F.col("phrase").alias("suf"), "rights")
        rows = own.where(F.col("words") == k).select("lang", "phrase", "n", "pre", "suf").join(first, ["lang", "pre"]).join(last, ["lang", "suf"])
        out.append(stored(rows.select("lang", "phrase", "n", "pre", "suf", F.concat("lefts", F.array("n")).alias("lefts"), F.concat("rights", F.array("n")).alias("rights")), "level"))
    return out


def _unsubsumed(levels: list[DataFrame], percent: int) -> list[DataFrame]:
    """Of each level, the phrases in no longer candidate of ``percent`` of their frequency. A phrase hears from those one
    word longer of the largest frequency around, theirs included; what is inside a phrase is inside one of them."""
    out, around = [levels[-1]], None
    for k in range(len(levels) - 2, 0, -1):
        longer = levels[k + 1]
        longer = longer.withColumn("around", F.col("n")) if around is None else longer.join(around, ["lang", "phrase"], "left").withColumn("around", F.greatest("n", F.coalesce("around", F.lit(0))))
        around = longer.select("lang", "around", F.explode(F.array("pre", "suf")).alias("phrase")).groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        around = stored(around, "around")
        wide = lambda c: F.col(c).cast("decimal(20,0)")
        out.append(levels[k].join(around, ["lang", "phrase"], "left").where(F.col("around").isNull() | (wide("around") * 100 < wide("n") * percent)).drop("around"))
    return out


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, percent: int = PERCENT, longest: int = LONGEST, width: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best phrases of two to ``longest`` words.

    A null language is ``und``, beside the rows that say so; an empty one is a language of its own. Null and empty
    texts have no words, and a language without words gives no rows. Rows that repeat count again. A text of any
    length is taken in parts, cut where a piece ends. Phrases with one score and frequency are in the order of their
    bytes. Other columns of ``docs`` don't matter. An empty table gives none. Counts are exact unless, in one slice
    of a task, two phrases agree in two 64-bit hashes; a false candidate of the sketch is counted exactly and goes.
    """
    found = frequent_phrases(docs, lang_col, text_col, least, longest, width)
    levels = _levels(found.where(F.col("phrase").isNotNull()), longest)
    whole = found.where(F.col("phrase").isNull()).select("lang", F.col("n").alias("total"))
    kept = functools.reduce(DataFrame.unionByName, _unsubsumed(levels, percent))
    wide = lambda c: c.cast("decimal(20,0)")
    words = F.size("lefts")
    left, right = lambda k: F.element_at("lefts", k), lambda k: F.element_at("rights", words - k)
    score = lambda k: F.call_function("div", wide(F.col("n")) * F.lit(2_000_000).cast("decimal(7,0)"), wide(left(k)) + wide(right(k)))
    cuts = F.transform(F.sequence(F.lit(1), words - 1), lambda k: F.struct(score(k).alias("score"), k.alias("k"), left(k).alias("l"), right(k).alias("r")))
    kept = kept.select("lang", "phrase", F.col("n").alias("a"), F.array_min(cuts).alias("c"))
    rows = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return dealt_join(ranked, whole, ["lang"], "inner").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLE_SQL = {
    "op13_collocations": rf"""
        WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        g AS (SELECT lang, k, w[i:i + k - 1] AS w FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) t(k) WHERE len(w) >= k)),
        t AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
        f AS (SELECT lang, k, w, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 30),
        c AS (SELECT f.lang, f.w, f.n AS a, j, l.n AS l, r.n AS r, (2000000 * f.n::HUGEINT // (l.n + r.n))::BIGINT AS score
            FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1) f JOIN f l ON l.lang = f.lang AND l.w = f.w[:j] JOIN f r ON r.lang = f.lang AND r.w = f.w[j + 1:]),
        b AS (SELECT lang, w, a, min_by(l, score * 10 + j) AS l, min_by(r, score * 10 + j) AS r, min(score) AS score FROM c GROUP BY lang, w, a),
        i AS (SELECT lang, w[s:s + m - 1] AS w, max(n) AS around FROM (SELECT *, unnest(range(1, k - m + 2)) AS s FROM (SELECT *, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL),
        o AS (SELECT b.*, array_to_string(b.w, ' ') AS phrase FROM b LEFT JOIN i USING (lang, w) WHERE around IS NULL OR 100 * around < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM o) JOIN t USING (lang) WHERE rank <= 2000
    """
}
