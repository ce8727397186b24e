"""What the operators share: the cluster's folder, written tables in place of long lineage, row keys."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes of rows that Spark sends a Python worker at once, where the session names no limit; a longer row is alone.
FRAME, FRAME_BYTES = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"
#: Most rows of a table of a few numbers or digests each that may be broadcast; at most about 20 MB.
BROADCAST_ROWS = 200_000


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, whatever their working folder, and bound their frames by bytes."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get(FRAME_BYTES, None) is None:
        spark.conf.set(FRAME_BYTES, FRAME)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Only a local session may do without:
    there driver and executors are one process, and a folder of its own is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: lineage ends here, and a lost
    executor costs no recomputation. The tables belong to the run; sweep the folder afterwards."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int | None = None, weight: Column | None = None) -> DataFrame:
    """``df`` marked for broadcast if it has few enough rows, else as it is. ``weight`` is a row's weight in
    rows of a few numbers, where rows hold arrays."""
    if weight is not None:
        rows = df.agg(F.sum(weight)).first()[0] or 0
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Parts that the rows of one key are dealt into where a table is too large to broadcast.
SALTS = 16


def dealt_join(rows: DataFrame, found: DataFrame, keys: list[str], how: str, n: int | None = None, limit: int | None = None) -> DataFrame:
    """``rows`` joined to ``found`` by ``keys``: by broadcast if ``found`` is small, else with the rows of each key
    dealt into SALTS parts, so that a key with a third of all rows doesn't come to one task."""
    n = found.count() if n is None else n
    if n <= (BROADCAST_ROWS if limit is None else limit):
        return rows.join(F.broadcast(found), keys, how)
    (salt,) = fresh(rows, "salt")
    dealt = found.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(dealt, [*keys, salt], how).drop(salt)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have yet, made of these."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trim() -> None:
    """Hand freed memory back to the system, where the C library can: a Python worker outlives its tasks."""
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)
    pa.default_memory_pool().release_unused()
