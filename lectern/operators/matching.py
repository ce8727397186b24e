"""Pairs of passages: all similar ones across groups, and a matching of them with capacities, in distributed rounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.vector_index import usable
from lectern.sources.scratch import written
from lectern.sources.workers import importable

#: Share of the pairs at exactly the threshold that may meet in no table; vectors of a block; tasks of one bucket.
MISSED, BLOCK, DEALT = 1e-5, 2048, 16
#: What sending a vector to a table costs, in comparisons.
SHIPPED = 2000


def tables_for(n: int, cosine: float, missed: float = MISSED, most_bits: int = 30) -> tuple[int, int]:
    """(bits, tables) of random hyperplanes: so many tables that a pair at ``cosine`` shares a bucket in one of them but
    for a chance of ``missed``, with the bits for which shipping and comparing cost least."""
    same = 1 - math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    best = None
    for bits in range(1, most_bits + 1):
        chance = same**bits
        tables = 1 if chance >= 1 else math.ceil(math.log(missed) / math.log1p(-chance))
        cost = tables * (SHIPPED + n / 2**bits)
        if best is None or cost < best[0]:
            best = cost, bits, tables
    return best[1:]


def vector_classes(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding, members): equal vectors of one label as one, under their smallest id; null vectors, and
    those with null or non-finite components, are left out."""
    rows = vectors.where(usable()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("members")).select("vec_id", "label", "embedding", "members")


def _coded(rows: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = {}
        for f in frames:
            for size, g in f.groupby(f["embedding"].map(len), sort=False):
                x = np.array(g["embedding"].tolist(), np.float64)
                x /= np.maximum(np.abs(x).max(1, keepdims=True), np.finfo(float).tiny)
                norm = np.linalg.norm(x, axis=1, keepdims=True)
                x = x / np.where(norm == 0, 1, norm)
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).normal(size=(size, tables * bits))
                codes = ((x @ planes[size]).reshape(len(x), tables, bits) > 0) @ (1 << np.arange(bits))
                yield pd.DataFrame({"vec_id": g["vec_id"].to_numpy(), "label": g["label"].to_numpy(), "members": g["members"].to_numpy(), "size": np.full(len(g), size, np.int32), "x": [r.tobytes() for r in x], "codes": codes.astype(np.int32).tolist()})

    return rows.mapInPandas(run, "vec_id long, label int, members long, size int, x binary, codes array<int>")


#: The label of a null in a block; labels are 32-bit.
NONE = 1 << 40
_BLOCK = ["ids binary", "labels binary", "members binary", "x binary"]


def _block(g: pd.DataFrame) -> dict:
    """Vectors of one length as one row's columns, of 64-bit numbers each."""
    column = lambda v: [np.asarray(v, np.int64).tobytes()]
    return {"block": int(g["vec_id"].iloc[0]), "ids": column(g["vec_id"]), "labels": column(g["label"].fillna(NONE)), "members": column(g["members"]), "x": [b"".join(g["x"])]}


def _in_blocks(rows: DataFrame) -> DataFrame:
    """(size, block, ..): all vectors in blocks, each once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for size, g in f.groupby("size", sort=False):
                for at in range(0, len(g), BLOCK):
                    yield pd.DataFrame({"size": np.int32(size), **_block(g.iloc[at : at + BLOCK])})

    return rows.select("size", "vec_id", "label", "members", "x").mapInPandas(run, ", ".join(["size int", "block long", *_BLOCK]))


def _in_buckets(rows: DataFrame) -> DataFrame:
    """(size, place, code, block, ..): a bucket's vectors in blocks; a bucket is dealt to DEALT tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for (size, place, code), g in f.groupby(["size", "place", "code"], sort=False):
                for at in range(0, len(g), BLOCK):
                    b = g.iloc[at : at + BLOCK]
                    yield pd.DataFrame({"size": np.int32(size), "place": np.int32(place), "code": np.int32(code), **_block(b), "codes": [np.stack(b["codes"].tolist()).astype(np.int32).tobytes()]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("size", F.posexplode("codes").alias("place", "code"), "vec_id", "label", "members", "x", "codes")
    dealt = placed.repartition(parts, "size", "place", "code", F.pmod(F.xxhash64("vec_id"), F.lit(DEALT))).sortWithinPartitions("size", "place", "code")
    return dealt.mapInPandas(run, ", ".join(["size int", "place int", "code int", "block long", *_BLOCK, "codes binary"]))


def _close(x: np.ndarray, y: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, score) of the unit rows whose cosine, rounded, reaches ``cosine``: single precision with room for its
    error finds them, double precision decides; in parts, as all pairs may."""
    room = 1e-6 + 2e-7 * x.shape[1]
    row, col = np.nonzero(x.astype(np.float32) @ y.astype(np.float32).T >= cosine - room)
    each = max(1, 2_000_000 // x.shape[1]) if x.shape[1] else max(1, len(row))
    for at in range(0, len(row), each):
        i, j = row[at : at + each], col[at : at + each]
        s = np.round(np.einsum("ij,ij->i", x[i], y[j]), 6)
        keep = s >= cosine
        yield i[keep], j[keep], s[keep]


def similar_pairs(vectors: DataFrame, cosine: float, across: bool = True, missed: float = MISSED, seed: int = 1) -> DataFrame:
    """(a, b, group_a, group_b, members_a, members_b, score): all pairs a < b with a cosine, rounded to 6 places, of at
    least ``cosine``; with ``across`` only those whose labels differ.

    ``vectors`` has vec_id, label, embedding; ids tell the rows apart. Equal vectors of one label are one class, under
    their smallest id, with ``members`` rows; pairs are between classes. Where comparing all classes costs less than
    shipping them to tables of random hyperplanes, all blocks of them meet, without a shuffle, and no pair is missed.
    Else only vectors that share a bucket in some table meet, in blocks, and each pair is reported by the first table
    in which it meets; a pair at the threshold is missed with a chance of ``missed``, one above it with less. Each pair
    found is compared in double precision. A null label is a group of its own that equals no other null. Zero vectors
    have a cosine of 0; vectors that are null or hold null or non-finite components are in no pair; vectors of unlike
    lengths don't meet. An empty table gives none.
    """
    importable(vectors.sparkSession)
    classes = written(vector_classes(vectors), "classes")
    n = max(1, classes.count())
    bits, tables = tables_for(n, cosine, missed)
    whole = n / 2 <= tables * (SHIPPED + n / 2**bits)
    keys = ["size"] if whole else ["size", "place", "code"]
    coded = _coded(classes, 1, 1, seed) if whole else _coded(classes, bits, tables, seed)
    blocks = written((_in_blocks if whole else _in_buckets)(coded), "blocks")
    left, right = (blocks.select(*(c if c in keys else F.col(c).alias(f"{side}_{c}") for c in blocks.columns)) for side in "lr")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = lambda b: np.frombuffer(b, np.int64)
        for f in frames:
            for r in f.itertuples():
                ids, others = numbers(r.l_ids), numbers(r.r_ids)
                x, y = np.frombuffer(r.l_x).reshape(len(ids), -1), np.frombuffer(r.r_x).reshape(len(others), -1)
                for i, j, s in _close(x, y, cosine):
                    a, b, ga, gb = ids[i], others[j], numbers(r.l_labels)[i], numbers(r.r_labels)[j]
                    keep = a != b if r.l_block != r.r_block else a < b
                    if across:
                        keep &= (ga != gb) | (ga == NONE)
                    if not whole and keep.any():
                        own, other = np.frombuffer(r.l_codes, np.int32).reshape(len(x), -1), np.frombuffer(r.r_codes, np.int32).reshape(len(y), -1)
                        keep[keep] = (own[i[keep]] == other[j[keep]]).argmax(1) == r.place
                    if keep.any():
                        i, j, a, b, ga, gb, s = (v[keep] for v in (i, j, a, b, ga, gb, s))
                        swap = a > b
                        pick = lambda u, v: np.where(swap, v, u)  # noqa: B023, E731
                        group = lambda v: pd.arrays.IntegerArray(np.where(v == NONE, 0, v).astype(np.int32), v == NONE)
                        ma, mb = numbers(r.l_members)[i], numbers(r.r_members)[j]
                        yield pd.DataFrame({"a": pick(a, b), "b": pick(b, a), "group_a": group(pick(ga, gb)), "group_b": group(pick(gb, ga)), "members_a": pick(ma, mb), "members_b": pick(mb, ma), "score": s})

    # With the hint each task reads two parts of the written blocks; a join by size would send them all to one.
    pairs = (left.hint("shuffle_replicate_nl") if whole else left).join(right, keys).where("l_block <= r_block")
    return pairs.mapInPandas(run, "a long, b long, group_a int, group_b int, members_a long, members_b long, score double")


#: Parts of a pair of groups in the first of two steps to its best pairs.
SALTS = 32
#: Pairs that the first batch of a matching has about; each next one has GROWTH times as many.
BATCH, GROWTH = 200_000, 8


def match_in_rounds(pairs: DataFrame, most: int = 3) -> DataFrame:
    """(a, b, group_a, group_b, score): the best pairs in turn, no passage twice and at most ``most`` of two groups.

    The same rows as a walk over all pairs by score descending, then a, then b, that takes what it may. The pairs are
    written once and walked in batches, all above a score each, the best first: what a batch doesn't take can't be
    taken after it, and the next one is drawn from the pairs below that score whose passages are free and whose groups
    have something left, so the walk ends with the capacities, mostly in the first batch. In a batch, a round takes
    each pair that is the best left of both of its passages and among the first that its two groups can still lend:
    whatever the walk does before it, it gets there with both passages free and capacity left. The best pair of all is
    always one, so rounds end; each leaves out the passages used and the groups exhausted. Only sums, and the first
    ``most`` pairs of two groups, meet in one task.

    Pairs with a null passage or score, or of a passage with itself, are left out. A null group is a group. Repeated
    pairs are one, with the better of two scores; (a, b) and (b, a) use the same passages. An empty table gives none.
    """
    spark = pairs.sparkSession
    columns = ["a", "b", "group_a", "group_b", "score"]
    rows = written(pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("score").isNotNull() & (F.col("a") != F.col("b"))).select(*columns), "pairs")
    # Two groups in either order, nulls told apart from all values.
    as_group = lambda c: F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("g"))
    open_ = rows.withColumn("groups", F.array_sort(F.array(as_group("group_a"), as_group("group_b")))).withColumn("left", F.lit(most))
    taken, size = [], BATCH
    while True:
        whole = open_.count()
        least = open_.agg(F.percentile_approx("score", 1 - size / whole, 100_000)).first()[0] if whole > size else None
        batch = open_ if least is None else open_.where(F.col("score") >= least)
        now = _rounds(written(batch.distinct(), "live"))
        taken += now
        if least is None:
            break
        open_ = open_.where(F.col("score") < least)
        for t in now:
            open_ = _without(open_, t)
        size *= GROWTH
    out = spark.createDataFrame([], rows.schema)
    for t in taken:
        out = out.unionByName(t.select(*columns))
    return out


def _without(live: DataFrame, taken: DataFrame) -> DataFrame:
    """Pairs (a, b, groups, left, ..) that may still be taken after ``taken``."""
    used = taken.select(F.explode(F.array("a", "b")).alias("p"))
    lent = taken.groupBy("groups").agg(F.count("*").cast("int").alias("lent"))
    rest = live.join(used.withColumnRenamed("p", "a"), "a", "left_anti").join(used.withColumnRenamed("p", "b"), "b", "left_anti")
    rest = rest.join(lent, "groups", "left").withColumn("left", F.col("left") - F.coalesce("lent", F.lit(0))).where("left > 0")
    return rest.select(*live.columns)


def _rounds(live: DataFrame) -> list[DataFrame]:
    """The pairs taken of a batch, by rounds, with their groups."""
    turn = [F.desc("score"), F.asc("a"), F.asc("b")]
    taken = []
    while True:
        salted = live.withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.lit(SALTS)))
        first = salted.withColumn("nth", F.row_number().over(Window.partitionBy("groups", "salt").orderBy(*turn))).where("nth <= left")
        first = first.withColumn("nth", F.row_number().over(Window.partitionBy("groups").orderBy(*turn))).where("nth <= left").drop("nth", "salt")
        # Each passage's best pair, a minimum over all that are left.
        ends = live.select(F.explode(F.array("a", "b")).alias("passage"), F.struct((-F.col("score")).alias("s"), "a", "b").alias("pair"))
        best = ends.groupBy("passage").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b", (-F.col("pair.s")).alias("score"))
        both = best.groupBy("a", "b", "score").agg(F.count("*").alias("ends")).where("ends = 2").drop("ends")
        now = written(first.join(both, ["a", "b", "score"]), "taken")
        if now.isEmpty():
            return taken
        taken.append(now)
        live = written(_without(live, now), "live")
