"""MinHash near-dedup (8): one permutation, optimal densification, banded buckets, star-shaped edges.

1. Signatures. Each text's distinct shingle hashes fall into BINS bins by their high bits; a bin's value
   is its least hash, and an empty bin takes the value of the bin that its own sequence of random probes
   meets first (optimal densification: the sequence depends on the bin and the attempt alone).
   BANDS runs of ROWS bins are the buckets. At a similarity of 0.8, (1 - 0.8^5)^32 = 3e-6 of the pairs
   share no bucket.
2. Stars. Texts whose whole sets have the same 128-bit BLAKE2 digest are one class. In each bucket the class
   that meets most others over all its buckets is the hub, and the only edges are those from hub to member,
   confirmed on full sets.
3. The rest, exactly. Members that aren't linked to their hub are compared with all members of that hub's
   buckets, in blocks of bounded bytes; only one edge from each text to its root in a block is passed on.
   So each pair that shares a bucket is either linked through its hub or compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .components import components
from .pretoken import spans
from .shared import dealt_join, fresh, prepare, small, stored, table, text_or_empty, trim

BINS, BANDS, ROWS = 160, 32, 5
#: Bytes of shingle hashes in one side of a block of comparisons.
BLOCK_BYTES = 4_000_000
#: Most members of a block of the rest, and of the block of a hub's members that they are held against.
REST, MEMBERS = 256, 2048

_PROBES = np.random.default_rng(8).integers(0, BINS, (BINS, 4096), dtype=np.int64)


def bands(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS bucket keys for each set of sorted hashes; sets must not be empty."""
    n = len(starts) - 1
    owner = np.repeat(np.arange(n), np.diff(starts))
    slot = owner * BINS + ((values >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.ones(len(slot), bool)
    first[1:] = slot[1:] != slot[:-1]
    bins, full = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    bins[slot[first]], full[slot[first]] = values[first], True
    bins, full = bins.reshape(n, BINS), full.reshape(n, BINS)
    at, source = np.nonzero(~full), None
    row, column = at
    source = np.full(len(row), -1)
    for attempt in range(_PROBES.shape[1]):
        open_ = np.flatnonzero(source < 0)
        if not len(open_):
            break
        probe = _PROBES[column[open_], attempt]
        hit = full[row[open_], probe]
        source[open_[hit]] = probe[hit]
    left = np.flatnonzero(source < 0)
    source[left] = full[row[left]].argmax(1)
    bins[row, column] = bins[row, source]
    keys = np.zeros((n, BANDS), np.uint64)
    for k in range(ROWS):
        keys = tb.mix(keys + bins.reshape(n, BANDS, ROWS)[:, :, k])
    return tb.mix(keys + np.arange(BANDS, dtype=np.uint64))


def _sets(frame: pa.RecordBatch, column: int, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """A megabyte of the frame's texts at a time: their rows, all sets' sorted hashes, and where each set starts."""
    for a, b in spans(frame.column(column)):
        part = frame.slice(a, b - a)
        raw = [(t or "").encode() for t in part.column(column).to_pylist()]
        _, _, hashes, bounds = tb.words(*tb.join_texts(raw))
        yield part, *tb.shingles(hashes, bounds, width)


def _pieces(values: np.ndarray, starts: np.ndarray) -> list[bytes]:
    data, at = values.tobytes(), (8 * starts).tolist()
    return [data[a:b] for a, b in zip(at, at[1:], strict=False)]


def _signatures(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part, values, starts in _sets(frame, 2, width):
                sizes = np.diff(starts)
                some = np.flatnonzero(sizes > 0)
                keys = bands(values, np.concatenate([starts[some], starts[-1:]])) if len(some) else np.zeros((0, BANDS), np.uint64)
                digests = pa.array([blake2b(x, digest_size=16).digest() for x in _pieces(values, starts)], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(sizes > 0, BANDS, 0))]).astype(np.int32)), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes), digests, lists], ["id", "key", "n_shingles", "digest", "bands"])
            trim()

    return run


def _set_bytes(width: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for part, values, starts in _sets(frame, 1, width):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_pieces(values, starts), pa.binary())], ["v", "shingles"])
            trim()

    return run


def _alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return 100 * shared >= percent * (len(both) - shared)


def _from_hub(percent: int):
    """Each member with whether it links to its hub; a group has one row of the hub itself."""

    def run(frame: pa.Table) -> pa.Table:
        ids, hubs, sets = frame["v"].to_pylist(), frame["hub"].to_pylist(), frame["shingles"].to_pylist()
        hub = next(np.frombuffer(s, np.uint64) for i, h, s in zip(ids, hubs, sets, strict=True) if i == h)
        keep = [k for k, (i, h) in enumerate(zip(ids, hubs, strict=True)) if i != h]
        return pa.table({"hub": pa.array([hubs[k] for k in keep], pa.int64()), "v": pa.array([ids[k] for k in keep], pa.int64()), "linked": pa.array([_alike(hub, np.frombuffer(sets[k], np.uint64), percent) for k in keep], pa.bool_())})

    return run


def _rest_links(percent: int):
    """Edges that connect what links between a block of the rest and a block of a hub's members.

    Shared shingles are counted for all pairs of the blocks by one pass over their merged hashes;
    pairs whose sizes alone rule a link out are left out of the result, not of the count.
    """

    def run(frame: pa.Table) -> pa.Table:
        ids = np.array(frame["v"].to_pylist(), np.int64)
        rest = np.array(frame["rest"].to_pylist(), bool)
        sets = [np.frombuffer(s, np.uint64) for s in frame["shingles"].to_pylist()]
        left, right = np.flatnonzero(rest), np.flatnonzero(~rest)
        sizes = np.array([len(s) for s in sets], np.int64)
        edges: list[tuple[int, int]] = []
        if len(left) and len(right):
            values = np.concatenate([sets[k] for k in left])
            owner = np.repeat(np.arange(len(left)), sizes[left])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for k in right:
                fits = (100 * np.minimum(sizes[left], sizes[k]) >= percent * np.maximum(sizes[left], sizes[k])) & (ids[left] != ids[k])
                if not fits.any():
                    continue
                lo, hi = np.searchsorted(values, sets[k], "left"), np.searchsorted(values, sets[k], "right")
                n = hi - lo
                lo, n = lo[n > 0], n[n > 0]
                where = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else lo, n) + np.arange(n.sum())
                shared = np.bincount(owner[where], minlength=len(left))
                good = fits & (100 * shared >= percent * (sizes[left] + sizes[k] - shared))
                edges += [(int(ids[left[j]]), int(ids[k])) for j in np.flatnonzero(good)]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        made = [(x, find(x)) for x in list(root) if find(x) != x]
        return pa.table({"a": pa.array([x for x, _ in made], pa.int64()), "b": pa.array([y for _, y in made], pa.int64())})

    return run


def _classes_of_one_id(useful: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Edges between the classes of ids that occur with several sets, if there are any."""
    each = useful.select("id", "digest").distinct()
    several = stored(each.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "several")
    if several.isEmpty():
        return None
    held = stored(each.join(several, "id").join(classes.select("digest", "v"), "digest").select("id", "v"), "several")
    return held.join(held.groupBy("id").agg(F.min("v").alias("a")), "id").select("a", F.col("v").alias("b"))


def _near_rows(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(id, key, n_shingles, component_id): a row for each row of ``docs``; key is a hash of the text."""
    prepare(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_or_empty(text_col)).alias("key"), F.col(text_col).alias("text"))
    signed = stored(texts.mapInArrow(_signatures(width), "id long, key long, n_shingles long, digest binary, bands array<long>"), "signatures")
    useful = signed.where("id is not null and n_shingles > 0")
    grouped = useful.groupBy("digest").agg(F.min(F.struct("id", "key")).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"), F.any_value("bands").alias("bands"))
    # Written before it is read, so a class keeps its number.
    classes = stored(grouped.select(F.monotonically_increasing_id().alias("v"), "digest", F.col("first.id").alias("rep"), F.col("first.key").alias("rep_key"), "copies", "n_shingles", "bands"), "classes")
    seats = classes.select("v", "n_shingles", F.explode("bands").alias("bucket"))
    # Tables that rows are joined to by a key that may be hot are written first, so that the join can be split.
    counts = stored(seats.groupBy("bucket").agg(F.count("*").alias("met")).where("met > 1"), "counts")
    placed = stored(seats.join(small(counts), "bucket"), "buckets")
    popular = stored(placed.groupBy("v").agg(F.sum("met").alias("popular")), "popular")
    ranked = placed.select("bucket", "v").join(popular, "v")
    best = ranked.groupBy("bucket").agg(F.max(F.struct("popular", (-F.col("v")).alias("v"))).alias("top")).select("bucket", (-F.col("top.v")).alias("hub"))
    best = stored(best, "best")
    pairs = stored(placed.select("bucket", "v", "n_shingles").join(small(best), "bucket").groupBy("hub", "v").agg(F.first("n_shingles").alias("n_shingles")), "pairs")
    wanted = stored(classes.join(popular.select("v"), "v", "left_semi").select(F.col("rep").alias("id"), F.col("rep_key").alias("key"), "v"), "wanted")
    n = wanted.count()
    sets = stored(texts.join(small(wanted, n), ["id", "key"]).select("v", "text").mapInArrow(_set_bytes(width), "v long, shingles binary"), "sets")
    if sets.count() > n:  # rows that repeat an id and its text
        sets = stored(sets.groupBy("v").agg(F.any_value("shingles").alias("shingles")), "sets")

    # A hub's members in blocks; the hub's own set goes to each of them. Only the large hubs have several.
    room = F.greatest(F.lit(8), F.least(F.lit(MEMBERS), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("widest"))))
    sizes = pairs.groupBy("hub").agg(F.count("*").alias("members"), F.max("n_shingles").alias("widest"))
    sizes = stored(sizes.withColumn("columns", F.ceil(F.col("members") / room).cast("int")), "hubs")
    large = small(sizes.where("columns > 1").select("hub", "columns"))
    columns = F.coalesce("columns", F.lit(1))
    dealt = pairs.where("v <> hub").join(large, "hub", "left").select("hub", "v", F.pmod(F.xxhash64("v"), columns).cast("int").alias("block"))
    centres = sizes.select("hub", F.col("hub").alias("v"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("block"))
    held = stored(dealt.union(centres).join(sets, "v").groupBy("hub", "block").applyInArrow(_from_hub(percent), "hub long, v long, linked boolean"), "held")

    loose = held.where("not linked")
    most = F.greatest(F.lit(8), F.least(F.lit(REST), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("widest"))))
    grid = loose.groupBy("hub").agg(F.count("*").alias("loose")).join(sizes, "hub").where("members > 2").select("hub", F.ceil(F.col("loose") / most).cast("int").alias("rows"), "columns")
    grid = small(stored(grid, "grid"))
    left = loose.join(grid, "hub").select("hub", "v", F.lit(True).alias("rest"), F.pmod(F.xxhash64("v", F.lit(1)), F.col("rows")).cast("int").alias("row"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("column"))
    right = held.join(grid, "hub").select("hub", "v", F.lit(False).alias("rest"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.pmod(F.xxhash64("v"), F.col("columns")).cast("int").alias("column"))
    rest = left.union(right).join(sets, "v").groupBy("hub", "row", "column").applyInArrow(_rest_links(percent), "a long, b long")
    links = held.where("linked").select(F.col("hub").alias("a"), F.col("v").alias("b")).union(rest)
    same = _classes_of_one_id(useful, classes)

    grown = components(links if same is None else links.union(same))
    roots = classes.select("v", "digest", "rep", "copies").join(grown.withColumnsRenamed({"id": "v", "component_id": "root"}), "v", "left").withColumn("root", F.coalesce("root", "v"))
    least = stored(roots.groupBy("root").agg(F.min("rep").alias("component_id")), "roots")
    changed = roots.join(least, "root").where("copies > 1 or component_id <> rep").select("digest", "component_id")
    plain = signed.select("id", "key", "n_shingles", "digest")
    # A class may have a third of all texts.
    found = dealt_join(plain.where("id is not null and n_shingles > 0"), stored(changed, "changed"), ["digest"], "left").select("id", "key", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return found.union(plain.where("id is null or n_shingles = 0").select("id", "key", "n_shingles", F.col("id").alias("component_id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id): a row for each row of ``docs``.

    Texts are lower-cased (A to Z) and split at ASCII white space; sets are of ``width``-word shingles, the
    whole sequence where there are fewer words. Two texts link when 100 * shared >= percent * united, so a
    pair at exactly that share links. component_id is the smallest id that links reach. A null, empty or
    blank text links with nothing, so its component is its own id. Rows that share an id are one document:
    it links wherever any of its texts does, and each row has the number of its own text's shingles. A row
    without id links with nothing and its component is null. An empty table gives none.
    """
    return _near_rows(docs, id_col, text_col, width, percent).select("id", "n_shingles", "component_id")


def minhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` with n_shingles, component_id and kept (the row's id is its component's).

    Columns of ``docs`` with those names are replaced; a row without id is kept. See near_duplicates().
    """
    rows = docs.drop("n_shingles", "component_id", "kept")
    near_id, near_key = fresh(rows, "near_id", "near_key")
    found = _near_rows(docs, id_col, text_col, width, percent).distinct().withColumnsRenamed({"id": near_id, "key": near_key})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(near_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(near_key))
    return rows.join(found, same, "left").drop(near_id, near_key).withColumn("kept", F.coalesce(F.col(id_col).cast("long") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that minhash_dedup() keeps; only what goes is joined to them. Null, empty and blank texts and
    rows without id stay, rows that repeat an id and its text go or stay together, an empty table gives none."""
    near_id, near_key = fresh(docs, "near_id", "near_key")
    gone = stored(_near_rows(docs, id_col, text_col, width, percent).where("id <> component_id").select(F.col("id").alias(near_id), F.col("key").alias(near_key)).distinct(), "gone")
    same = (F.col(id_col).cast("long") == F.col(near_id)) & (F.xxhash64(text_or_empty(text_col)) == F.col(near_key))
    return docs.join(small(gone), same, "left_anti")


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), width=4)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, then the smallest id that links reach.
ORACLE_SQL = {
    "op8_minhash_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + least(3, len(w) - 1)], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        r(id, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
        c AS (SELECT id, least(id, min(root)) AS component_id FROM r GROUP BY id)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = doc_id
    """
}
