"""Approximate cosine search: inverted lists around centroids, kept as a table and searched without comparing all.

``build`` writes a folder with two tables: ``centroids``, and ``lists``, whose partitions are the lists and whose rows
are blocks of unit vectors. Vectors of a list that holds a large share of all rows are dealt to several tasks. A
search sends the centroids (MOST_LISTS at most) to all tasks, gives each query to its nearest lists, and joins blocks
of queries to blocks of vectors by list, so that only probed lists are read and only they are compared. How many
lists a search probes is measured when the index is built: as many as make the stated recall on a sample of its own
vectors, held against the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.retrieval import best_of_blocks, dense
from lectern.sources.workers import importable

#: Most lists; vectors that centroids are learned from, and queries that probes are measured with, at most.
MOST_LISTS, SAMPLE, ASKED = 4096, 65_536, 256
#: Rounds of learning, vectors and queries of a block, and tasks that one list is dealt to.
ROUNDS, BLOCK, QUERIES, DEALT = 8, 4096, 512, 16


def usable(embedding: str = "embedding") -> Column:
    """Whether a vector can be searched: there, with components, all of them finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(embedding).isNotNull() & (F.size(embedding) > 0) & ~F.exists(embedding, odd)


def _unit(x: pd.Series) -> np.ndarray:
    out = np.array(x.tolist(), np.float64)
    out /= np.maximum(np.abs(out).max(1, keepdims=True), np.finfo(float).tiny)  # no square overflows or vanishes
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def learn_centroids(x: np.ndarray, lists: int, seed: int = 1) -> np.ndarray:
    """Spherical k-means of unit vectors; a centroid without vectors takes the one that is farthest from its own."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(ROUNDS):
        s = x @ c.T
        own = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(s.max(1))[: len(empty)]]
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.where(norm == 0, 1, norm), c)
    return c


def _nearest(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """(list, near, vec_id, label, embedding): each row with its ``probes`` nearest lists, near from 1."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                order = np.argsort(-(_unit(f["embedding"]) @ sent.value.T), axis=1, kind="stable")[:, :probes]
                out = f.loc[f.index.repeat(order.shape[1])].reset_index(drop=True)
                yield pd.DataFrame({"list": order.ravel().astype(np.int32), "near": np.tile(np.arange(1, order.shape[1] + 1, dtype=np.int32), len(f)), "vec_id": out["vec_id"], "label": out["label"], "embedding": out["embedding"]})

    return rows.select("vec_id", "label", "embedding").mapInPandas(run, "list int, near int, vec_id long, label int, embedding array<double>")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of a list as (list, ids, labels, matrix) blocks; a list's rows are dealt to DEALT tasks at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for own, g in f.groupby("list", sort=False):
                for at in range(0, len(g), size):
                    part = g.iloc[at : at + size]
                    yield pd.DataFrame({"list": pd.Series([own], dtype=np.int32), f"{name}_ids": [part["vec_id"].tolist()], f"{name}_labels": [part["label"].tolist()], f"{name}_x": [_unit(part["embedding"]).tobytes()]})

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "list", F.pmod(F.xxhash64("vec_id"), F.lit(DEALT))).sortWithinPartitions("list")
    return dealt.select("list", "vec_id", "label", "embedding").mapInPandas(run, f"list int, {name}_ids array<long>, {name}_labels array<int>, {name}_x binary")


def _vectors(df: DataFrame) -> DataFrame:
    return df.where(usable()).select(F.col("vec_id").cast("long"), F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"), F.col("embedding").cast("array<double>"))


def build(vectors: DataFrame, path: str, lists: int | None = None, recall: float = 0.95, k: int = 10, sample: int = SAMPLE) -> int:
    """Write the index of vectors (vec_id, label, embedding) to ``path``; how many lists a search probes.

    Centroids are learned from at most ``sample`` vectors, those with the smallest hashes of their ids; every vector
    is indexed. Null vectors and those with null or non-finite components are not; a zero vector is, with a cosine of
    0 to all. A null label is -1. Rows that repeat an id are indexed each. An empty table makes an empty index.
    """
    spark = importable(vectors.sparkSession)
    rows = _vectors(vectors)
    few = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).toPandas()
    n = rows.count()
    lists = lists or min(MOST_LISTS, max(1, 2 ** round(math.log2(max(n, 1)) / 2)))
    centroids = learn_centroids(_unit(few["embedding"]), lists) if len(few) else np.zeros((0, 1))
    placed = _nearest(rows, centroids, 1)
    _blocks(placed, BLOCK, "v").write.partitionBy("list").parquet(f"{path}/lists")
    probes = _measured(rows, placed, few.head(ASKED), centroids, recall, k) if len(few) else 1
    made = [(i, c.tolist(), probes) for i, c in enumerate(centroids)]
    spark.createDataFrame(made, "list int, centroid array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
    return probes


def _measured(rows: DataFrame, placed: DataFrame, asked: pd.DataFrame, centroids: np.ndarray, recall: float, k: int) -> int:
    """The least number of lists in which the share ``recall`` of the true neighbours of ``asked`` lies."""
    queries = rows.sparkSession.createDataFrame(asked, "vec_id long, label int, embedding array<double>")
    true = dense(rows, queries, k).select("qid", "vec_id")
    near = _nearest(queries, centroids, len(centroids)).select(F.col("vec_id").alias("qid"), "list", "near")
    at = true.join(placed.select("vec_id", "list"), "vec_id").join(near, ["qid", "list"]).groupBy("near").agg(F.count("*").alias("n")).orderBy("near").collect()
    total, seen = sum(r.n for r in at), 0
    for r in at:
        seen += r.n
        if seen >= recall * total:
            return r.near
    return 1


def read_centroids(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS at most
    return np.array([r.centroid for r in rows]), max((r.probes for r in rows), default=1)


def add(vectors: DataFrame, path: str) -> None:
    """Append vectors to their lists; centroids stay."""
    centroids, _ = read_centroids(importable(vectors.sparkSession), path)
    _blocks(_nearest(_vectors(vectors), centroids, 1), BLOCK, "v").write.partitionBy("list").mode("append").parquet(f"{path}/lists")


def search(queries: DataFrame, path: str, k: int = 10, probes: int | None = None, other_label: bool = False) -> DataFrame:
    """(qid, vec_id, score, rank): as dense(), of the lists nearest to each query (vec_id, label, embedding).

    ``probes`` is the number of lists; by default, what reached the recall of the build. With all lists the result
    is exact. Queries that can't be searched have no hits.
    """
    spark = importable(queries.sparkSession)
    centroids, measured = read_centroids(spark, path)
    if not len(centroids):
        return spark.createDataFrame([], "qid long, vec_id long, score double, rank int")
    near = _nearest(_vectors(queries), centroids, min(probes or measured, len(centroids)))
    kept = spark.read.schema("v_ids array<long>, v_labels array<int>, v_x binary, list int").parquet(f"{path}/lists")
    pairs = _blocks(near, QUERIES, "q").join(kept, "list")
    return best_of_blocks(pairs.drop("list"), k, other_label)
