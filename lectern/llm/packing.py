"""Packing (2): concatenate and cut, by prefix sums in two passes.

Pass 1 tokenises every text once, ends it with a separator, and writes its ids with its offset among the
ids of its scan partition. The partitions' totals are summed up in two levels (within blocks of partitions,
then over the blocks), which gives each partition's first offset in the stream of all ids. Pass 2 cuts the
stream at multiples of the window: a text's pieces follow from its global offset alone, without a shuffle.
Each piece is a boundary record: which ids of which text lie where in which sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretoken import SLICE, Chunked, binaries, spans, stretches, text_bytes, white
from .shared import prepare, small, stored, table, trim

#: Partitions whose totals one task sums up.
BLOCK = 4096
#: Most chunks that a worker keeps the ids of.
CHUNKS = 750_000

_CODERS: dict[str, Chunked] = {}


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the files of byte-level vocabularies: printable bytes stand for
    themselves, the others, in order, for the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def byte_level_encoding(path: str):
    """(encoding, special tokens by text) of a byte-level BPE tokenizer's JSON file.

    The merges run in tiktoken, which takes the pair whose joined bytes have the lowest id. That is the file's
    order of merges where each merge makes the next id, which is checked; then a pair's bytes are a token just
    where the file has that merge, and the ids are those of the tokenizers library.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    tokenizer = json.loads(Tokenizer.from_file(path).to_str())
    model, letter = tokenizer["model"], byte_letters()
    ranks = {bytes(letter[c] for c in token): i for token, i in model["vocab"].items()}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    single = tokenizer["pre_tokenizer"]
    if single != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} or tokenizer["normalizer"] or [model["vocab"]["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
        raise ValueError(f"{path} is no plain byte-level BPE whose merges are in the order of ids")
    special = {t["content"]: t["id"] for t in tokenizer["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in tokenizer["added_tokens"]):
        raise ValueError(f"{path} has special tokens that take more than their own text")
    #: Fixed value: the pattern of byte-level pre-tokenisation.
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("packing", pat_str=words, mergeable_ranks=ranks, special_tokens=special), special


def coder(path: str) -> Chunked:
    """One for each Python worker: the tokenizer and the ids of common chunks stay between tasks."""
    if path not in _CODERS:
        encoding, special = byte_level_encoding(path)
        marks = [s.encode() for s in special]
        length = np.zeros(1 + max([encoding.max_token_value, *special.values()]), np.int64)
        for i in encoding._mergeable_ranks.values():
            length[i] = len(encoding.decode_single_token_bytes(i))

        def encode(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            space, raw = white(data), data.tobytes()
            # Chunks that begin with white space and end without can be encoded on end, as in a text.
            alone = ~space[starts[:-1]] | space[starts[1:] - 1]
            for mark in marks:
                at = raw.find(mark)
                while at >= 0:
                    alone[np.searchsorted(starts, at, "right") - 1] = True
                    at = raw.find(mark, at + 1)
            lone = np.flatnonzero(alone)
            single = [encoding.encode(raw[starts[i] : starts[i + 1]].decode(), allowed_special="all") for i in lone.tolist()]
            rest = np.flatnonzero(~alone)
            sizes = np.diff(starts)[rest]
            joined = encoding.encode_to_numpy(stretches(data, starts[rest], sizes).tobytes().decode(), disallowed_special=())
            ends = np.searchsorted(np.cumsum(length[joined]), np.cumsum(sizes)) + 1
            counts = np.empty(len(starts) - 1, np.int64)
            counts[lone], counts[rest] = [len(x) for x in single], np.diff(ends, prepend=0)
            owner = np.repeat(np.concatenate([lone, rest]), np.concatenate([counts[lone], counts[rest]]))
            ids = np.concatenate([np.fromiter(chain.from_iterable(single), np.uint32), joined.astype(np.uint32)])
            return ids[np.argsort(owner, kind="stable")], counts

        _CODERS[path] = Chunked(encode, CHUNKS)
    return _CODERS[path]


def token_stream(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id_col, part, start, ids): ids with the separator, and the ids before them in their partition. A null or empty
    text is its separator; repeated rows and null ids are rows as any; an empty table gives none."""
    prepare(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, at = coder(path), TaskContext.get().partitionId(), 0
        for frame in frames:
            for a, b in spans(frame.column(1), SLICE):
                ids, starts = encode(*text_bytes(frame.column(1).slice(a, b - a)))
                whole = np.insert(ids, starts[1:], np.uint32(end_id))
                starts = starts + np.arange(len(starts))
                yield pa.RecordBatch.from_arrays([frame.column(0).slice(a, b - a), pa.array(np.full(b - a, part, np.int32)), pa.array(at + starts[:-1]), binaries(whole.astype("<u4"), 4 * starts)], [id_col, "part", "start", "ids"])
                at += len(whole)
        trim()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, part int, start long, ids binary")


def first_offsets(totals: DataFrame) -> DataFrame:
    """(part, base): ids before each partition's, by sums within blocks of partitions and then over blocks."""
    totals = totals.withColumn("block", F.floor(F.col("part") / BLOCK))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    within = totals.withColumn("base", F.coalesce(F.sum("n").over(before(Window.partitionBy("block").orderBy("part"))), F.lit(0)))
    blocks = totals.groupBy("block").agg(F.sum("n").alias("n")).select("block", F.coalesce(F.sum("n").over(before(Window.orderBy("block"))), F.lit(0)).alias("ahead"))
    return within.join(blocks, "block").select("part", (F.col("base") + F.col("ahead")).alias("base"))


def pack(docs: DataFrame, path: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """(id_col, start, length, doc_tokens, sequence_id, offset, ids): the pieces of all rows' ids.

    All texts' ids, each text's ended by ``end_id``, make one stream in the order of the scan, cut every
    ``window`` ids; only the last sequence can be short. Ids are those of the tokenizers library with
    add_special_tokens=False; a special token's string in a text has that token's id. A null or empty text is
    its separator alone. Repeated rows and ids are packed as often as they occur, null ids too; other columns
    of ``docs`` are not read. An empty table gives none.
    """
    stream = stored(token_stream(docs, path, id_col, text_col, end_id), "tokens")
    total = stored(stream.groupBy("part").agg(F.sum(F.octet_length("ids") / 4).cast("long").alias("n")), "totals")
    bases = stored(first_offsets(total), "offsets")
    n = (F.octet_length("ids") / 4).cast("long")
    placed = stream.join(small(bases), "part").select(F.col(id_col), "ids", n.alias("doc_tokens"), (F.col("base") + F.col("start")).alias("at"))
    # A text's pieces are cut within its row, so that no row carries more than its own ids.
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("doc_tokens") - 1) / window)

    def piece(k):
        start = F.greatest(F.col("at"), k * window) - F.col("at")
        length = F.least(F.col("doc_tokens"), (k + 1) * window - F.col("at")) - start
        own = F.col("ids").substr((4 * start + 1).cast("int"), (4 * length).cast("int"))
        return F.struct(start.alias("start"), length.alias("length"), k.alias("sequence_id"), (F.col("at") + start - k * window).alias("offset"), own.alias("ids"))

    cut = placed.select(id_col, "doc_tokens", F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
    return cut.select(id_col, "p.start", "p.length", "doc_tokens", "p.sequence_id", "p.offset", "p.ids")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, n_tokens): each sequence's ids joined; at most a window's, so a row is bounded. Without pieces
    there are none; pieces have an offset each, so none are null or repeat."""
    joined = F.expr("aggregate(transform(array_sort(collect_list(struct(offset, ids))), x -> x.ids), cast('' as binary), (a, x) -> concat(a, x))")
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("n_tokens"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
