"""Embedding near-dedup (6): iterative quantisation, multi-index Hamming tables, rerank with the vectors.

A rotation of the centred vectors' principal axes is learned on a bounded sample so that signs lose least;
a vector's code is the signs of its rotated coordinates, and each bit halves the sample about evenly. Each
table takes some of the code's bits, about as many as tell the table's vectors apart, so that buckets stay
small as the input grows, and there are as many tables as the wanted recall needs at that width. Two vectors
meet in a table where they differ in one of its bits at most: each vector is at home in its own bucket and
visits those that lie one set bit below. A pair counts in the first table where it meets, so no pair is
looked at twice and none is ever a row: a bucket yields each vector's number of links in it and one edge to
its root. Buckets are dealt in blocks of bounded size, and every meeting pair's cosine is taken of the original
vectors in double precision. Vectors of each length have a rotation and tables of their own. Equal vectors are one
class, which links once for all its members.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import components
from .shared import dealt_join, prepare, small, stored, table

#: Vectors that the rotations are learned on, all lengths together, and rounds of learning.
SAMPLE, ROUNDS = 8192, 40
#: Share of the pairs at the least cosine that may meet in no table, whatever the number of vectors, and bits of a
#: code at most.
MISSED, BITS = 0.04, 64
#: Most vectors at home in a block of a bucket, and most that they are held against in it.
HOME, OTHERS = 512, 2048


def masks(n: int, bits: int, cosine: float) -> list[int]:
    """The bits of each table for n vectors with codes of so many bits.

    A bit differs with the share angle / pi of pairs; bits are taken in turn from shuffles of all, so each is in
    about as many tables.
    """
    # Fewer than half of a short code's bits, or pairs that differ in two bits would meet nowhere.
    width = max(1, min(math.ceil(math.log2(max(n, 256))), bits // 2 if bits < 32 else bits - 1))
    p = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    missed = 1 - (1 - p) ** width - width * p * (1 - p) ** (width - 1)
    count = max(4, math.ceil(math.log(MISSED) / math.log(missed))) if missed > 1e-9 else 4
    rng, queue, out = np.random.default_rng(11), [], []
    for _ in range(count):
        own: list[int] = []
        while len(own) < width:
            queue = queue or rng.permutation(bits).tolist()
            at = next((k for k, x in enumerate(queue) if x not in own), None)
            if at is None:
                queue = rng.permutation(bits).tolist()
                continue
            own.append(queue.pop(at))
        out.append(sum(1 << x for x in own))
    return out


def learn(sample: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): sign((x - mean) @ projection) is the code."""
    mean = sample.mean(0)
    centred = sample - mean
    bits = min(BITS, sample.shape[1])
    _, axes = np.linalg.eigh(centred.T @ centred)
    axes = axes[:, ::-1][:, :bits]
    v = centred @ axes
    rotation = np.linalg.qr(np.random.default_rng(6).standard_normal((bits, bits)))[0]
    for _ in range(rounds):
        code = np.where(v @ rotation >= 0, 1.0, -1.0)
        u, _, w = np.linalg.svd(code.T @ v)
        rotation = w.T @ u.T
    return mean, axes @ rotation


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in doubles; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    signs = np.zeros((len(x), 64), np.uint8)
    signs[:, : projection.shape[1]] = (x - mean) @ projection >= 0
    return np.packbits(signs, axis=1, bitorder="little").view("<u8").ravel()


def _links(data: np.ndarray, code: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, number: np.ndarray, tables: np.ndarray, cosine: float) -> np.ndarray:
    """Which of the pairs (left, right) meet first in the table that ``number`` names, and link."""
    good = ids[left] != ids[right]
    differ = code[left] ^ code[right]
    for t, mask in enumerate(tables):
        near = np.bitwise_count(differ & mask) < 2
        good &= np.where(number == t, near, (number < t) | ~near)
    at = np.flatnonzero(good)
    for a in range(0, len(at), 200_000):
        part = at[a : a + 200_000]
        good[part] = np.einsum("ij,ij->i", data[left[part]], data[right[part]]) >= cosine
    return good


def _bucket_links(tables: dict[int, np.ndarray], cosine: float, kind: str):
    """Streams sorted (size, bucket, row, column) blocks; each gives (id, n, root) of its vectors that link, n being the
    members of the classes that they link to."""

    def solve(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sizes = rows["size"].to_numpy()
        cuts = np.flatnonzero(np.append(True, sizes[1:] != sizes[:-1])).tolist()
        for a, b in zip(cuts, [*cuts[1:], len(sizes)], strict=True):
            yield _solve(rows.slice(a, b - a).combine_chunks(), int(sizes[a]))

    def _solve(rows: pa.Table, size: int) -> pa.RecordBatch:
        ids, code = rows["id"].to_numpy(), rows["code"].to_numpy().view(np.uint64)
        home, side = rows["home"].to_numpy(), rows["side"].to_numpy()
        data = unit(np.frombuffer(b"".join(rows["vector"].to_pylist()), kind).reshape(-1, size))
        members = rows["members"].to_numpy()
        block = np.stack([rows[c].to_numpy().astype(np.int64) for c in ("tab", "bucket", "row", "column")], 1)
        cuts = np.flatnonzero(np.append(True, (block[1:] != block[:-1]).any(1)))
        number = rows["tab"].to_numpy()
        lefts, rights, found = [], [], []

        def take() -> None:
            left, right = np.concatenate(lefts), np.concatenate(rights)
            good = _links(data, code, ids, left, right, number[left], tables[size], cosine)
            found.append((left[good], right[good]))
            lefts.clear()
            rights.clear()

        waiting = 0
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
            l_, r_ = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
            if not len(l_) or not len(r_):
                continue
            left, right = np.repeat(l_, len(r_)), np.tile(r_, len(l_))
            once = ~home[right] | (ids[left] < ids[right])  # two that are at home meet from both sides
            lefts.append(left[once])
            rights.append(right[once])
            waiting += len(left)
            if waiting > 2_000_000:
                take()
                waiting = 0
        if lefts:
            take()
        at_left, at_right = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
        left, right = ids[at_left], ids[at_right]
        some, which = np.unique(np.concatenate([left, right]), return_inverse=True)
        n = np.zeros(len(some), np.int64)
        np.add.at(n, which, np.concatenate([members[at_right], members[at_left]]))
        l_, r_, root = np.searchsorted(some, left), np.searchsorted(some, right), np.arange(len(some))
        while len(l_):
            low = np.minimum(root[l_], root[r_])
            new = root.copy()
            np.minimum.at(new, l_, low)
            np.minimum.at(new, r_, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(n, pa.int64()), pa.array(some[root] if len(some) else some, pa.int64())], ["id", "n", "root"])

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for frame in frames:
            if not frame.num_rows:
                continue
            now = pa.Table.from_batches([frame])
            held = now if held is None else pa.concat_tables([held, now])
            keys = [held[c].to_numpy() for c in ("size", "tab", "bucket", "row", "column")]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            whole = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0  # rows before the last block
            if whole:
                yield from solve(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None and held.num_rows:
            yield from solve(held)

    return run


def _models(able: DataFrame, cosine: float) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Mean, projection and tables' masks for each length that two vectors have; a bounded sample comes to the driver."""
    counts = {r["size"]: r["count"] for r in able.groupBy("size").count().where("count > 1").collect()}
    if not counts:
        return {}
    most = max(64, SAMPLE // len(counts))
    order = Window.partitionBy("size").orderBy(F.xxhash64("id"), "id")
    sample: dict[int, list] = {}
    for r in able.where(F.col("size").isin(list(counts))).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).select("size", "vector").collect():
        sample.setdefault(r["size"], []).append(r["vector"])
    return {size: (*learn(unit(np.array(x))), np.array(masks(counts[size], min(BITS, size), cosine), np.uint64)) for size, x in sample.items()}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """(id_col, n_links, component_id, kept): a row for each row of ``vectors``.

    Vectors that are null or zero, or hold null or non-finite components, link with nothing; others link with
    vectors of their own length. A pair whose cosine is exactly ``cosine`` links. Rows that share an id are
    one vector, the smallest of theirs; a row without id has no links and no component, and is kept. Other
    columns are not read. An empty table gives none. Pairs that meet in no table are missed: an expected
    MISSED of those at ``cosine``, fewer of the closer ones.
    """
    spark = prepare(vectors.sparkSession)
    good = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))) & F.exists(vector_col, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"))
    # Floats stay floats, all else is compared as doubles.
    kind, own = ("<f4", "array<float>") if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else ("<f8", "array<double>")
    valid = stored(vectors.where(F.col(id_col).isNotNull() & good).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(own).alias("vector")).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    # Equal vectors under their smallest id: they link with each other, and all with what one links with.
    able = stored(valid.groupBy("vector").agg(F.min("id").alias("id"), F.count("*").alias("members")).withColumn("size", F.size("vector")), "classes")
    several = able.where("members > 1").select("vector", F.col("id").alias("class_id"), "members")
    classes = stored(dealt_join(valid, several, ["vector"], "inner").select("id", "class_id", "members"), "members")
    models = _models(able, cosine)
    result = "id long, n long, root long"
    if not models:
        found = spark.createDataFrame([], result)
    else:
        tables = {size: m[2] for size, m in models.items()}

        def coded(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for frame in frames:
                of = frame.column(2).to_numpy()
                for size in np.unique(of).tolist():
                    part = frame.filter(pa.array(of == size))
                    mean, projection, own_tables = models[size]
                    x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, size)
                    code = codes(unit(x), mean, projection)
                    keys: list[list[dict]] = [[] for _ in range(len(code))]
                    for t, mask in enumerate(own_tables):
                        single = [1 << k for k in range(64) if int(mask) >> k & 1]
                        for i, c in enumerate((code & mask).tolist()):
                            keys[i].append((t, c - 2**63, True))
                            keys[i] += [(t, (c ^ k) - 2**63, False) for k in single if c & k]
                    seats = pa.array([[{"tab": t, "bucket": c, "home": h} for t, c, h in k] for k in keys], pa.list_(pa.struct([("tab", pa.int32()), ("bucket", pa.int64()), ("home", pa.bool_())])))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in x], pa.binary()), part.column(2), pa.array(code.view(np.int64)), part.column(3), seats], ["id", "vector", "size", "code", "members", "seats"])

        some = able.where(F.col("size").isin(list(models))).select("id", "vector", "size", "members")
        placed = stored(some.mapInArrow(coded, "id long, vector binary, size int, code long, members long, seats array<struct<tab:int,bucket:long,home:boolean>>"), "codes")
        where = ["size", "tab", "bucket"]
        seats = placed.select("id", "size", F.explode("seats").alias("seat")).select("id", "size", "seat.*")
        counts = seats.groupBy(*where).agg(F.count_if("home").alias("at_home"), F.count("*").alias("all")).where("at_home > 0 and all > 1")
        blocks = stored(counts.select(*where, F.ceil(F.col("at_home") / HOME).cast("int").alias("rows"), F.ceil(F.col("all") / OTHERS).cast("int").alias("columns")), "blocks")
        large = blocks.where("rows > 1 or columns > 1")
        # Most buckets are one block; which are live is asked of all seats, how many blocks of the large ones.
        live = seats.join(blocks.select(*where), where, "left_semi").join(small(large), where, "left").withColumns({"rows": F.coalesce("rows", F.lit(1)), "columns": F.coalesce("columns", F.lit(1))})
        pick = lambda n, seed: F.expr(f"cast(pmod(xxhash64(id, {seed}), {n}) as int)")
        left = live.where("home").select("id", *where, "home", F.lit(0).alias("side"), pick("rows", 1).alias("row"), F.explode(F.expr("sequence(0, columns - 1)")).alias("column"))
        right = live.select("id", *where, "home", F.lit(1).alias("side"), F.explode(F.expr("sequence(0, rows - 1)")).alias("row"), pick("columns", 2).alias("column"))
        dealt = left.union(right).join(placed.select("id", "vector", "code", "members"), "id")
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        order = ["size", "tab", "bucket", "row", "column"]
        dealt = dealt.repartition(n, *order).sortWithinPartitions(*order)
        found = stored(dealt.mapInArrow(_bucket_links(tables, cosine, kind), result), "links")
    degree = found.groupBy("id").agg(F.sum("n").alias("n_links"))
    grown = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    # A class's links and component are its members'; alike vectors link whatever the least cosine up to 1.
    of_class = degree.join(grown, "id", "full").select(F.col("id").alias("class_id"), "n_links", "component_id")
    out = rows.join(classes, "id", "left").withColumn("class_id", F.coalesce("class_id", "id"))
    out = dealt_join(out, of_class, ["class_id"], "left")
    own = F.coalesce("component_id", "class_id")
    alike = F.when(F.lit(cosine <= 1), F.coalesce(F.col("members") - 1, F.lit(0))).otherwise(F.lit(0)).cast("long")
    return out.select(F.col("id").alias(id_col), (F.coalesce("n_links", F.lit(0).cast("long")) + alike).alias("n_links"), own.alias("component_id"), F.col("id").eqNullSafe(own).alias("kept"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
