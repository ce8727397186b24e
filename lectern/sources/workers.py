"""Python workers that can import this package, whatever their working folder, and whose frames are bounded."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Most bytes of rows that a Python worker gets at once, where the session names no limit; a longer row is alone.
FRAME, FRAME_BYTES = 4_000_000, "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> SparkSession:
    """Name this package's folder to the Python workers of jobs that begin after this, and bound their frames by bytes."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    if spark.conf.get(FRAME_BYTES, None) is None:
        spark.conf.set(FRAME_BYTES, FRAME)
    return spark
