"""Count-min sketches of 64-bit keys that are made in partitions, merged by blocks of counters, and asked by all tasks.

A sketch has two rows of ``width`` counters (a power of two); a key counts in the counter of its lowest bits and in
that of its bits from 32 on. A counter is never below the count of any of its keys, so keys of which a row's
counter is below a threshold are surely rarer; the others are candidates, to be counted exactly. Merged counters
come back as one bit each (whether they reach the threshold): width / 4 bytes in all, which is what is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Counters of a block, the unit that is merged.
BLOCK = 2**18
#: Keys that a task holds before it sends their counts: 8 bytes each.
HELD = 8_000_000
LEAST_WIDTH, MOST_WIDTH = 2**16, 2**28

SCHEMA = "sketch_row int, block int, bytes_each int, body binary"


def width_for(keys: float, each: int = 1) -> int:
    """The least width with a counter for every ``each`` keys, within bounds: a broadcast has 64 MB at most. With
    more keys than the largest width is meant for more of the rare keys pass as candidates; none is lost."""
    width = LEAST_WIDTH
    while width < min(keys / each, MOST_WIDTH):
        width *= 2
    return width


class Sketcher:
    """What one task counts; ``rows`` gives record batches of blocks of counters."""

    def __init__(self, width: int):
        self.width, self.block = width, min(width, BLOCK)
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
        mask = np.uint64(self.width - 1)
        self.held.append(((keys & mask).astype(np.uint32), ((keys >> np.uint64(32)) & mask).astype(np.uint32)))
        self.n += len(keys)
        if self.n >= HELD:
            yield from self.rows()

    def rows(self) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for row in (0, 1):
            at = np.concatenate([h[row] for h in self.held]) if self.held else np.zeros(0, np.uint32)
            at.sort()
            edges = np.searchsorted(at, np.arange(0, self.width + 1, self.block, dtype=np.uint64))
            out: list[tuple] = []
            for b in range(len(edges) - 1):
                if edges[b] == edges[b + 1]:
                    continue
                counts = np.bincount(at[edges[b] : edges[b + 1]] - np.uint32(b * self.block), minlength=self.block)
                each = 1 if counts.max() < 256 else 8
                out.append((row, b, each, codec.compress(counts.astype(f"<u{each}").tobytes(), asbytes=True)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["sketch_row", "block", "bytes_each", "body"])
        self.held, self.n = [], 0


def _merged(width: int, least: int) -> Callable:
    block = min(width, BLOCK)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, now, total = pa.Codec("zstd"), None, np.zeros(block, np.int64)

        def done():
            bits = np.packbits(total >= least, bitorder="little").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([bits], pa.binary())], ["sketch_row", "block", "bits"])

        for frame in frames:
            for row, b, each, body in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                if now != (row, b):
                    if now is not None:
                        yield done()
                    now = (row, b)
                    total[:] = 0
                total += np.frombuffer(codec.decompress(body, block * each), f"<u{each}").astype(np.int64)
        if now is not None:
            yield done()

    return run


def heavy_counters(blocks: DataFrame, width: int, least: int) -> Broadcast:
    """The merged rows of sketches (SCHEMA) as one bit a counter that reaches ``least``, sent to all tasks.

    Blocks are dealt by (row, block) and added up one at a time, sorted, so that a task holds one block whatever
    the number of sketches."""
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    merged = blocks.repartition(parts, "sketch_row", "block").sortWithinPartitions("sketch_row", "block").mapInArrow(_merged(width, least), "sketch_row int, block int, bits binary")
    out = np.zeros((2, width // 8), np.uint8)
    each = min(width, BLOCK) // 8
    for r in merged.collect():  # width / 4 bytes
        out[r.sketch_row, r.block * each : (r.block + 1) * each] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(out)


def may_be_heavy(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of each key whether both of its counters reach the threshold."""
    mask = np.uint64(bits.shape[1] * 8 - 1)
    out = None
    for row, at in enumerate((keys & mask, (keys >> np.uint64(32)) & mask)):
        if out is None:
            out = (bits[row][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        else:
            some = np.flatnonzero(out)
            at = at[some]
            out[some] = (bits[row][(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def text_bytes(docs: DataFrame, text_col: str) -> int:
    return docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
