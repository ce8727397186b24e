"""Line dedup (4): content-defined chunks of lines, removed where the same bytes stand elsewhere.

1. Chunks. A chunk of LEAST lines or more ends after a line where the rolling hash over the last SPAN lines' hashes is 0
   modulo DIVISOR, or at MOST lines, so an inserted line moves only the boundaries near it. In a run of three equal
   lines or more, where a rolling hash stands still, a chunk ends before the run and after each second line of it.
2. Repeats. Chunks of two lines or more with one 128-bit hash stay at their first place in the smallest document and
   are removed everywhere else. Chunks don't overlap, so a chunk that stays stays whole.
3. Neighbours. A repeated passage begins and ends within chunks. From each removed chunk on, lines of the chunks beside
   it go too as far as they equal those beside the place that stays; never lines of a chunk that repeats itself, and
   only where nothing near the place that stays is removed. So all that is removed in one place stands whole, on end,
   in another.
4. Bytes. The bytes of all places of a repeated chunk, and of each passage with its neighbours, are compared by their
   smallest and largest; where two differ, all is done again with another seed.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, dealt_join, fresh, prepare, small, stored, table, text_or_empty

SPAN, DIVISOR, LEAST, MOST, RUN = 2, 2, 2, 64, 3
_BASE, _MASK = 0x9E3779B97F4A7C15, 2**64 - 1
#: Rows of a frame that are cut into lines at once.
ROWS = 1000


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(first line, end) of each chunk, in order; together they are all lines."""
    ends, hard, rolled, hashes = set(), set(), 0, [xxhash.xxh3_64_intdigest(x) for x in lines]
    gone = pow(_BASE, SPAN, 2**64)
    for i, h in enumerate(hashes):
        rolled = (rolled * _BASE + h) & _MASK
        if i >= SPAN:
            rolled = (rolled - hashes[i - SPAN] * gone) & _MASK
        if (rolled ^ rolled >> 29) % DIVISOR == 0:
            ends.add(i + 1)
    at = 0
    while at < len(lines):
        to = at + 1
        while to < len(lines) and hashes[to] == hashes[at] and lines[to] == lines[at]:
            to += 1
        if to - at >= RUN:
            ends.difference_update(range(at + 1, to))
            hard.update({at, to}, range(at + 2, to, 2))
        at = to
    out, begin = [], 0
    hard.add(len(lines))
    for end in sorted((ends | hard) - {0}):
        while end - begin > MOST:
            out.append((begin, begin + MOST))
            begin += MOST
        if end - begin >= LEAST or (end in hard and end > begin):
            out.append((begin, end))
            begin = end
    return out


def chunk_hash(lines: list[bytes], seed: int) -> int:
    """128 bits of lines on end."""
    return xxhash.xxh3_128_intdigest(b"\n".join(lines), seed)


def _signed(h: int) -> tuple[int, int]:
    return (h >> 64) - 2**63, (h & _MASK) - 2**63


_KINDS = {"id": pa.int64(), "key": pa.int64(), "at": pa.int32(), "h1": pa.int64(), "h2": pa.int64(), "first": pa.int32(), "end": pa.int32(), "left": pa.list_(pa.int64()), "right": pa.list_(pa.int64()), "body": pa.binary()}
_SQL = {pa.int64(): "long", pa.int32(): "int", pa.list_(pa.int64()): "array<long>", pa.binary(): "binary"}


def _schema(names: list[str]) -> str:
    return ", ".join(f"`{n}` {_SQL[_KINDS[n]]}" for n in names)


def _rows(names: list[str], rows_of):
    """One row for each that ``rows_of`` gives for a frame's row."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for at in range(0, frame.num_rows, ROWS):
                part, rows = frame.slice(at, ROWS), []
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    rows += rows_of(*values)
                columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, _KINDS[n]) for c, n in zip(columns, names, strict=True)], names)

    return run


def repeated_places(docs: DataFrame, seed: int) -> DataFrame:
    """(id, key, at, h1, h2, first, end, left, right, stays): all places of the chunks that repeat, of docs (id, key, text).

    ``at`` is the chunk's number in its text, ``left`` and ``right`` are the hashes of the lines of the chunks beside
    it, the nearest first. The place that stays is the first in the smallest (id, key); a null id is the largest.
    """

    def seen(i, key, text):
        lines = (text or "").encode().split(b"\n")
        return [(i, key, n, *_signed(chunk_hash(lines[a:b], seed))) for n, (a, b) in enumerate(chunks(lines)) if b - a > 1]

    def places(i, key, text):
        lines = (text or "").encode().split(b"\n")
        cut, out = chunks(lines), []
        own = [xxhash.xxh3_64_intdigest(x, seed + 1) - 2**63 for x in lines]
        for n, (a, b) in enumerate(cut):
            if b - a > 1:
                left = own[cut[n - 1][0] : a][::-1] if n else []
                right = own[b : cut[n + 1][1]] if n + 1 < len(cut) else []
                out.append((i, key, n, *_signed(chunk_hash(lines[a:b], seed)), a, b, left, right))
        return out

    names = ["id", "key", "at", "h1", "h2"]
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "at"))
    counted = docs.mapInArrow(_rows(names, seen), _schema(names)).groupBy("h1", "h2").agg(F.count("*").alias("n"), first.alias("keeper"))
    found = stored(counted.where("n > 1").select("h1", "h2", F.col("keeper.id").alias("k_id"), F.col("keeper.key").alias("k_key"), F.col("keeper.at").alias("k_at")), "repeated")
    names += ["first", "end", "left", "right"]
    placed = docs.mapInArrow(_rows(names, places), _schema(names))
    joined = dealt_join(placed, found, ["h1", "h2"], "inner", limit=BROADCAST_ROWS)
    stays = F.col("id").eqNullSafe(F.col("k_id")) & (F.col("key") == F.col("k_key")) & (F.col("at") == F.col("k_at"))
    # Rows that repeat an id and its text have the same places.
    return stored(joined.withColumn("stays", stays).drop("k_id", "k_key", "k_at").dropDuplicates(["id", "key", "at"]), "places")


def _common(a: str, b: str) -> Column:
    """How many items two arrays share from their start on."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    return F.when(differs > 0, differs - 1).otherwise(F.size(a)).cast("int")


def removals(places: DataFrame) -> DataFrame:
    """(id, key, h1, h2, first, end, more, k_id, k_key, k_first, k_end): what goes, neighbours included, and the place
    where the same lines stay; ``more`` are the lines that it has before and after its chunk."""
    order = Window.partitionBy("id", "key").orderBy("at")
    none = F.expr("cast(array() as array<long>)")

    def beside(step):
        """Whether the next chunk on a side repeats, and whether it or the one after it goes."""
        near = [(step(F.col("at"), k).over(order) - F.col("at"), ~step(F.col("stays"), k).over(order)) for k in (1, 2)]
        is_at = lambda d, n: F.coalesce(F.abs(d) == n, F.lit(False))
        gone = [is_at(d, n) & F.coalesce(g, F.lit(False)) for d, g in near for n in (1, 2)]
        return is_at(near[0][0], 1), gone[0] | gone[1] | gone[2] | gone[3]

    (repeats_l, gone_l), (repeats_r, gone_r) = beside(F.lag), beside(F.lead)
    marked = places.withColumns({"repeats_l": repeats_l, "gone_l": gone_l, "repeats_r": repeats_r, "gone_r": gone_r})
    kept = marked.where("stays").select("h1", "h2", F.col("id").alias("k_id"), F.col("key").alias("k_key"), F.col("first").alias("k_first"), F.col("end").alias("k_end"), F.when(F.col("gone_l"), none).otherwise(F.col("left")).alias("k_left"), F.when(F.col("gone_r"), none).otherwise(F.col("right")).alias("k_right"))
    both = dealt_join(marked.where("not stays"), kept, ["h1", "h2"], "inner", limit=BROADCAST_ROWS // 10)
    before = F.when(F.col("repeats_l"), 0).otherwise(_common("left", "k_left"))
    after = F.when(F.col("repeats_r"), 0).otherwise(_common("right", "k_right"))
    both = both.withColumns({"l": before, "r": after})
    more = F.struct("l", "r").alias("more")
    ends = [(F.col(a) - F.col("l")).alias(a) if a.endswith("first") else (F.col(a) + F.col("r")).alias(a) for a in ("first", "end", "k_first", "k_end")]
    return stored(both.select("id", "key", "h1", "h2", more, "k_id", "k_key", *ends), "removals")


def differing(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(h1, h2) of places (id, key, h1, h2, first, end) whose bytes differ. Only texts with such places are read, each
    place's bytes are sent as the smallest and largest of a task; without places there are none, and nulls in ids
    are equal."""
    at = places.groupBy(F.col("id").alias("place_id"), F.col("key").alias("place_key")).agg(F.collect_set(F.struct("h1", "h2", "first", "end")).alias("places"))
    with_text = docs.join(at, F.col("id").eqNullSafe(F.col("place_id")) & (F.col("key") == F.col("place_key"))).select("text", "places")

    def bodies(text, places):
        lines = (text or "").encode().split(b"\n")
        return [(p["h1"], p["h2"], b"\n".join(lines[p["first"] : p["end"]])) for p in places]

    made = with_text.mapInArrow(_rows(["h1", "h2", "body"], bodies), "h1 long, h2 long, body binary")
    return made.groupBy("h1", "h2").agg(F.min("body").alias("low"), F.max("body").alias("high")).where("low <> high").select("h1", "h2")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, the text without its removed lines, and n_lines and n_removed (long).

    A null text stays null, with no lines; an empty one has one line. A text whose lines are all removed is
    empty. Rows that repeat an id and its text are one document; rows that share an id alone are told apart by
    their texts. A null id is larger than all others. Columns named like the results are replaced, others stay
    whatever their names. An empty table gives none.
    """
    prepare(docs.sparkSession)
    plain = docs.drop("n_lines", "n_removed")
    cut_id, cut_key, cuts_col = fresh(plain, "cut_id", "cut_key", "cuts")
    text_key = F.xxhash64(text_or_empty(text_col))
    keyed = plain.select(F.col(id_col).cast("long").alias("id"), text_key.alias("key"), F.col(text_col).alias("text"))
    seed = 0
    while True:
        places = repeated_places(keyed, seed)
        gone = removals(places)
        wider = gone.where("more.l + more.r > 0").withColumn("h1", F.xxhash64("h1", "h2", "more"))
        sides = wider.select("id", "key", "h1", "h2", "first", "end").unionByName(wider.select(F.col("k_id").alias("id"), F.col("k_key").alias("key"), "h1", "h2", F.col("k_first").alias("first"), F.col("k_end").alias("end")).distinct())
        if differing(keyed, places.select(*sides.columns).unionByName(sides)).isEmpty():
            break
        seed += 1
    cuts = stored(gone.groupBy(F.col("id").alias(cut_id), F.col("key").alias(cut_key)).agg(F.collect_list(F.struct("first", "end")).alias(cuts_col)), "cuts")
    names, at = plain.columns, plain.columns.index(text_col)
    found = small(cuts, weight=F.size(cuts_col) + 1)
    joined = plain.join(found, F.col(id_col).cast("long").eqNullSafe(F.col(cut_id)) & (text_key == F.col(cut_key)), "left").select(*(F.col(c) for c in names), cuts_col)
    schema = docs.drop("n_lines", "n_removed").schema.add("n_lines", "long").add("n_removed", "long")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_frame in frames:
            for start in range(0, whole_frame.num_rows, ROWS):
                frame, texts, total, removed = whole_frame.slice(start, ROWS), [], [], []
                for text, cut in zip(frame.column(at).to_pylist(), frame.column(frame.num_columns - 1).to_pylist(), strict=True):
                    lines = [] if text is None else text.split("\n")
                    total.append(len(lines))
                    if cut:
                        drop = {i for c in cut for i in range(c["first"], c["end"])}
                        lines = [x for i, x in enumerate(lines) if i not in drop]
                        text = "\n".join(lines)
                    texts.append(text)
                    removed.append(total[-1] - len(lines))
                columns = frame.columns[:-1]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], schema.fieldNames())

    return joined.mapInArrow(run, schema)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
