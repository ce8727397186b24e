"""Byte-level BPE over texts as byte arrays: chunks that tokenise alone, their ids kept in a bounded table.

A chunk is a run of white space and the run of other characters after it. No match of the tokenizers'
patterns crosses from one chunk to the next: only the last blank before a word belongs to a match with it, and
nothing looks behind. So a text's ids are its chunks' ids in turn, and a chunk is encoded once however often
it occurs. Finding chunks, looking them up and putting the ids together are array operations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textbytes as tb

#: The characters with Unicode's White_Space property beyond ASCII, in UTF-8.
WIDE_WHITE = ["c285", "c2a0", "e19a80", "e28080", "e28081", "e28082", "e28083", "e28084", "e28085", "e28086", "e28087", "e28088", "e28089", "e2808a", "e280a8", "e280a9", "e280af", "e2819f", "e38080"]
_CODES = np.array(sorted(int(x, 16) for x in WIDE_WHITE))
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Bytes of text whose chunks are hashed at once, and that one call of an encoder takes new chunks of.
BLOCK, SLICE = 1_000_000, 1_000_000
#: Most chunks and ids that a table keeps; a full one is begun anew.
MOST_CHUNKS, MOST_IDS = 1_500_000, 8_000_000


def pattern(pat: str):
    """The tokenizer's pattern with white space as in Rust's regular expressions."""
    import regex

    return regex.compile(pat.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column's texts on end, and where each starts (one more than texts); a null text is empty."""
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) else b"", column.type))
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32, len(column) + 1, 4 * column.offset).astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[starts[0] : starts[-1]], starts - starts[0]


def white(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space."""
    out = tb.SPACE[data]
    lead = np.flatnonzero(_LEAD[data])
    if len(lead):
        b = [data[np.minimum(lead + k, len(data) - 1)].astype(np.int64) for k in range(3)]
        two, three = np.isin(b[0] << 8 | b[1], _CODES), np.isin(b[0] << 16 | b[1] << 8 | b[2], _CODES)
        for k, which in ((0, two | three), (1, two | three), (2, three)):
            out[lead[which] + k] = True
    return out


def chunk_starts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """First byte of each chunk of all texts; each text begins one."""
    space = white(data)
    edge = space.copy()
    edge[1:] &= ~space[:-1]
    edge[starts[:-1][starts[:-1] < starts[1:]]] = True
    return np.flatnonzero(edge)


_OTHER = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each stretch that begins at ``first``; the last one ends with the data."""
    ends, out = np.append(first[1:], len(data)), []
    forward, back = tb.powers(len(data))
    for weights in (tb.WEIGHTS, _OTHER):
        sums = np.empty(len(data) + 1, np.uint64)
        sums[0] = 0
        np.cumsum(weights[data] * forward[: len(data)], out=sums[1:])
        out.append(tb.mix((sums[ends] - sums[first]) * back[first]))
    return out[0], out[1]


class Table:
    """Ids by the two hashes of a chunk: open addressing over arrays that grow."""

    def __init__(self, bits: int = 16):
        self.n, self.used = 0, 0
        self.keys, self.check, self.at, self.size = np.empty(1024, np.uint64), np.empty(1024, np.uint64), np.empty(1024, np.int64), np.empty(1024, np.int64)
        self.ids = np.empty(4096, np.uint32)
        self._clear(bits)

    def _clear(self, bits: int) -> None:
        self.bits, self.slots = bits, np.full(1 << bits, -1, np.int32)

    def find(self, keys: np.ndarray, check: np.ndarray) -> np.ndarray:
        """Entry of each pair of hashes, or -1."""
        mask = (1 << self.bits) - 1
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        open_ = np.flatnonzero(out >= 0)
        while len(open_):
            own = out[open_]
            open_ = open_[(self.keys[own] != keys[open_]) | (self.check[own] != check[open_])]
            at[open_] = (at[open_] + 1) & mask
            out[open_] = self.slots[at[open_]]
            open_ = open_[out[open_] >= 0]
        return out

    def _grown(self, x: np.ndarray, need: int) -> np.ndarray:
        return x if need <= len(x) else np.concatenate([x, np.empty(max(need, 2 * len(x)) - len(x), x.dtype)])

    def add(self, keys: np.ndarray, check: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Entries that aren't in the table yet, each once; ids on end."""
        n = self.n + len(keys)
        for name in ("keys", "check", "at", "size"):
            setattr(self, name, self._grown(getattr(self, name), n))
        self.ids = self._grown(self.ids, self.used + len(ids))
        new = slice(self.n, n)
        self.keys[new], self.check[new], self.size[new] = keys, check, sizes
        self.at[new] = self.used + np.cumsum(sizes) - sizes
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        begin, self.n = self.n, n
        if 2 * n > len(self.slots):
            self._clear(max(self.bits + 1, (2 * n).bit_length() + 1))
            begin = 0
        self._seat(begin)

    def _seat(self, begin: int) -> None:
        mask, entry = (1 << self.bits) - 1, np.arange(begin, self.n, dtype=np.int32)
        at = (self.keys[begin : self.n] >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(entry):
            free = self.slots[at] < 0
            self.slots[at[free]] = entry[free]  # of several for one slot one wins
            lost = self.slots[at] != entry
            entry, at = entry[lost], (at[lost] + 1) & mask

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries' ids on end, and how many each has."""
        return stretches(self.ids, self.at[entries], self.size[entries]), self.size[entries]


def stretches(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[first : first + size] of each, on end."""
    before = np.cumsum(sizes) - sizes
    return values[np.repeat(first - before, sizes) + np.arange(int(sizes.sum()))]


class Chunked:
    """Encodes texts by their chunks; ``encode`` takes different chunks' bytes on end and where each starts (one
    more than chunks), and gives their ids on end and how many each has."""

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], most_chunks: int = MOST_CHUNKS, most_ids: int = MOST_IDS):
        self.encode, self.most_chunks, self.most_ids, self.table = encode, most_chunks, most_ids, Table()

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts on end, and where each text's start (one more than texts)."""
        if self.table.n > self.most_chunks or self.table.used > self.most_ids:
            self.table = Table()
        first = chunk_starts(data, starts)
        if not len(first):
            return np.zeros(0, np.uint32), np.zeros(len(starts), np.int64)
        entries = self.entries(data, first)
        ids, sizes = self.table.gather(entries)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        return ids, ends[np.searchsorted(first, starts)]

    def entries(self, data: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The table's entry of each chunk; new chunks are encoded and added."""
        ends = np.append(first[1:], len(data))
        keys, check, at = np.empty(len(first), np.uint64), np.empty(len(first), np.uint64), 0
        while at < len(first):
            to = max(at + 1, int(np.searchsorted(ends, first[at] + BLOCK, "right")))
            keys[at:to], check[at:to] = hashes(data[first[at] : ends[to - 1]], first[at:to] - first[at])
            at = to
        found = self.table.find(keys, check)
        new = np.flatnonzero(found < 0)
        if len(new):
            _, one, which = np.unique(keys[new], return_index=True, return_inverse=True)
            if (check[new[one]][which] != check[new]).any():  # one first hash, two chunks
                _, one, which = np.unique(np.stack([keys[new], check[new]], 1), axis=0, return_index=True, return_inverse=True)
            some = new[one]
            lengths = ends[some] - first[some]
            ids, sizes = self.encode(stretches(data, first[some], lengths), np.concatenate([[0], np.cumsum(lengths)]))
            before = self.table.n
            self.table.add(keys[some], check[some], ids, sizes)
            found[new] = before + which.ravel()
        return found


def binaries(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """A binary column of stretches of an array's bytes; starts are bytes, one more than rows."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(np.ascontiguousarray(starts, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def spans(column: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most so many bytes together, found without decoding; a longer row is alone."""
    at, size = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        if size and size + n > most:
            yield at, i
            at, size = i, 0
        size += n
    if at < len(column):
        yield at, len(column)
