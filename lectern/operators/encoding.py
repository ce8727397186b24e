"""Encoding passages and queries as vectors: a registry of encoders, and one that works offline."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lectern.functions.text import tokens

SPECIAL_TOKENS = 2


@dataclass(frozen=True)
class Encoder:
    """``load`` makes, once in each worker, a function from a list of texts to an array of one row a text."""

    name: str
    load: Callable[[], Callable[[list[str]], np.ndarray]]
    limit: int = 256
    query_prefix: str = ""


ENCODERS: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    ENCODERS[encoder.name] = encoder
    return encoder


def encoder(name: str) -> Encoder:
    if name not in ENCODERS:
        raise ValueError(f"no encoder {name}; there are {sorted(ENCODERS)}")
    return ENCODERS[name]


#: Terms whose places a worker remembers, and texts that it encodes at once.
REMEMBERED, AT_ONCE = 100_000, 512


def hashed(size: int = 64) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Counts of terms in ``size`` places: a term's place and sign are the first digits of its MD5. A stand-in
    for a trained model."""

    def load() -> Callable[[list[str]], np.ndarray]:
        known: dict[str, int] = {}

        def place(term: str) -> int:
            """Of the places for plus, then those for minus."""
            digits = md5(term.encode()).hexdigest()
            return int(digits[:2], 16) % size + (0 if int(digits[2], 16) < 8 else size)

        def part(texts: list[str]) -> np.ndarray:
            found = [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]
            terms = [t for f in found for t in f]
            if len(known) > REMEMBERED:
                known.clear()
            known.update((t, place(t)) for t in set(terms).difference(known))
            at = np.fromiter(map(known.__getitem__, terms), np.int64, len(terms))
            owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
            counts = np.bincount(owner * 2 * size + at, minlength=len(texts) * 2 * size).reshape(len(texts), 2, size)
            return (counts[:, 0] - counts[:, 1]).astype(np.float64)

        def encode(texts: list[str]) -> np.ndarray:
            return np.concatenate([np.zeros((0, size)), *(part(texts[at : at + AT_ONCE]) for at in range(0, len(texts), AT_ONCE))])

        return encode

    return load


register(Encoder("hash64", hashed()))


def _encoded(text: Column, name: str, prefix: str) -> Column:
    load = encoder(name).load

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = load()
        for part in parts:
            yield pd.Series(list(encode([prefix + (t or "") for t in part])), index=part.index)

    return run(text)


def encode_passages(text: Column, name: str = "hash64") -> Column:
    return _encoded(text, name, "")


def encode_queries(text: Column, name: str = "hash64") -> Column:
    """As passages, after the encoder's prefix."""
    return _encoded(text, name, encoder(name).query_prefix)


def token_stats(chunks: DataFrame, name: str = "hash64") -> DataFrame:
    """``chunks`` with token_count (special tokens included) and truncated (more than the encoder's limit)."""
    n = F.size(tokens(F.col("text"))) + SPECIAL_TOKENS
    return chunks.withColumn("token_count", n).withColumn("truncated", n > encoder(name).limit)


def truncation_report(chunks: DataFrame, name: str = "hash64") -> DataFrame:
    """By strategy: chunks, truncated ones and their percentage, at the encoder's limit."""
    return token_stats(chunks, name).groupBy("strategy").agg(F.count("*").alias("n_chunks"), F.count_if("truncated").alias("truncated"), F.round(100 * F.count_if("truncated") / F.count("*"), 2).alias("pct_truncated"))
