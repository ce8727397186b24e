"""Byte-level BPE encoding and decoding (5): a merge replay over the corpus's distinct words.

1. Every scan partition gives its distinct words that are no token themselves; a word's count is the number
   of partitions that have it.
2. The words of two partitions or more (the most widespread, up to SHARED) are replayed once for the corpus.
   An inverted index maps each merge that is possible now to the positions of its token pairs in the words;
   merges are taken in rank order, and a merge touches only its neighbours' entries. While merges have many
   positions, one merge is a few array operations over all of them; the rest is taken position by position.
3. Texts are put together from their words' ids. Words that one partition alone has, and those beyond SHARED,
   are replayed there, all new ones of several megabytes of text at once.

Words are independent, so the lowest rank over all words is, for a word that has it, also that word's lowest.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pretoken import Chunked, Table, binaries, chunk_starts, hashes, pattern, spans, stretches, text_bytes
from .shared import prepare, stored, table, trim

#: Most words whose ids every worker holds; about 50 bytes each.
SHARED = 500_000
#: Bytes of a word that may be sent to all tasks.
LONGEST = 64
#: Most words beyond those that a worker keeps, and bytes of words that one replay takes.
OWN, REPLAY = 300_000, 4_000_000
#: Bytes of text whose new words are replayed together, and most chunks whose ids a worker keeps.
PART, CHUNKS = 4_000_000, 700_000
#: Ranks are indexed in bands of so many (a power of two); with fewer positions a merge, merges are taken singly.
BAND, FEW = 6, 6
_NONE = 2**31 - 1


def _distinct(x: np.ndarray) -> np.ndarray:
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


def last_merges(ranks: dict[bytes, int]) -> np.ndarray:
    """(first, second, rank) of the merge that makes each token where its bytes stand alone.

    Only these merges ever happen: what happens within a stretch that nothing crosses depends on its bytes
    alone, so two tokens that lie side by side in any word and join to a token are those that lie so, last,
    in the token's own bytes.
    """
    out = []
    for token, rank in ranks.items():
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            least, at = min((ranks.get(x + y, _NONE), k) for k, (x, y) in enumerate(zip(parts, parts[1:], strict=False)))
            if least == _NONE:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((ranks[parts[0]], ranks[parts[1]], rank))
    return np.array(out, np.int32).reshape(-1, 3)


class Replay:
    """``byte`` holds the rank of each single byte, ``merges`` rows of (first, second, rank), one for each rank."""

    def __init__(self, byte: np.ndarray, merges: np.ndarray):
        self.byte, self.size = byte, 1 + int(max(byte.max(), merges[:, 2].max(initial=0)))
        of = np.full(self.size, -1)
        of[byte] = np.arange(256)
        #: Rank of the merge of two bytes.
        self.first = np.full((256, 256), _NONE, np.int32)
        two = merges[(of[merges[:, 0]] >= 0) & (of[merges[:, 1]] >= 0)]
        self.first[of[two[:, 0]], of[two[:, 1]]] = two[:, 2]
        #: All possible merges by first token (second, rank), and by second token (first, rank).
        self.second, self.before = (self._by(merges[:, [k, 1 - k, 2]]) for k in range(2))
        #: Whether a merge always has a higher rank than its parts, so that it never comes too late.
        self.rising = bool((merges[:, 2] > np.maximum(merges[:, 0], merges[:, 1])).all())
        self.lists: tuple[dict, dict] | None = None

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Replay:
        return cls(np.array([ranks[bytes([b])] for b in range(256)], np.int32), last_merges(ranks))

    def _by(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        return np.searchsorted(rows[:, 0], np.arange(self.size + 1)), rows[:, 1].copy(), rows[:, 2].copy()

    @staticmethod
    def _ranks(by: tuple[np.ndarray, np.ndarray, np.ndarray], own: int, others: np.ndarray) -> np.ndarray:
        offsets, keys, ranks = by
        a, b = offsets[own], offsets[own + 1]
        if a == b:
            return np.full(len(others), _NONE, np.int32)
        at = np.minimum(np.searchsorted(keys[a:b], others), b - a - 1)
        return np.where(keys[a:b][at] == others, ranks[a:b][at], np.int32(_NONE))

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words on end, and how many each has; words are bytes on end, with one more start than words."""
        ids, sizes, at, n = [], [], 0, len(starts) - 1
        while at < n:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + REPLAY, "right")) - 1)
            i, s = self._merge(data[starts[at] : starts[to]], starts[at : to + 1] - starts[at])
            ids.append(i)
            sizes.append(s)
            at = to
        return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)])

    def _merge(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # Each word is followed by an end, which merges with nothing.
        n, total = len(starts) - 1, len(data) + len(starts) - 1
        place = np.arange(len(data)) + np.repeat(np.arange(n), np.diff(starts))
        ends = starts[1:] + np.arange(n)
        #: By position: the token there, the rank of its merge with the next one, its neighbours.
        tokens, possible = np.full(total, -1, np.int32), np.full(total, _NONE, np.int32)
        tokens[place] = self.byte[data]
        inner = np.flatnonzero(np.diff(place) == 1)
        possible[place[inner]] = self.first[data[inner], data[inner + 1]]
        after, before = np.arange(1, total + 1, dtype=np.int32), np.arange(-1, total - 1, dtype=np.int32)
        if not self._by_arrays(tokens, possible, after, before):
            # Of the words that have merges left, what is alive; neighbours are then side by side.
            words = np.zeros(n, bool)
            words[np.searchsorted(ends, np.flatnonzero(possible < _NONE))] = True
            left = np.flatnonzero((tokens > -2) & np.repeat(words, np.diff(ends, prepend=-1)))
            tokens[left] = self._singly(tokens[left], possible[left])
        live = tokens >= 0
        return tokens[live].astype(np.uint32), np.diff(np.cumsum(live)[ends], prepend=0)

    def _by_arrays(self, tokens: np.ndarray, possible: np.ndarray, after: np.ndarray, before: np.ndarray) -> bool:
        """Merges in rank order as long as they have many positions; whether all are done."""
        if not self.rising:
            return False
        index: list[list[np.ndarray]] = [[] for _ in range((self.size >> BAND) + 1)]

        def enter(places: np.ndarray, ranks: np.ndarray) -> None:
            bands = ranks >> BAND
            order = np.argsort(bands, kind="stable")
            places, bands = places[order], bands[order]
            cuts = np.flatnonzero(bands[1:] != bands[:-1]) + 1
            for b, part in zip(bands[np.append(0, cuts)].tolist() if len(bands) else [], np.split(places, cuts), strict=False):
                index[b].append(part)

        places = np.flatnonzero(possible < _NONE)
        enter(places, possible[places])
        for band in range(len(index)):
            if not index[band]:
                continue
            places = _distinct(np.concatenate(index[band]))
            index[band] = []
            places = places[possible[places] >> BAND == band]
            if not len(places):
                continue
            ranks = possible[places]
            order = np.argsort(ranks, kind="stable")
            ranks = ranks[order]
            cuts = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
            heap = ranks[cuts]
            if len(places) < FEW * len(heap):
                return False
            heap = heap.tolist()  # sorted, so a heap
            groups = {r: [p] for r, p in zip(heap, np.split(places[order], cuts[1:]), strict=True)}
            while heap:
                rank = heapq.heappop(heap)
                parts = groups.pop(rank)
                p = parts[0] if len(parts) == 1 else _distinct(np.concatenate(parts))
                p = p[possible[p] == rank]
                if not len(p):
                    continue
                q = after[p]
                if (q[:-1] == p[1:]).any():  # runs of one token: every other pair, from the left
                    at = np.arange(len(p))
                    begin = np.maximum.accumulate(np.where(np.append(True, q[:-1] != p[1:]), at, 0))
                    p = p[(at - begin) % 2 == 0]
                    q = after[p]
                following = after[q]
                tokens[p], tokens[q], possible[q] = rank, -2, _NONE
                after[p], before[following] = following, p
                left = before[p]
                new_left, new = self._ranks(self.before, rank, tokens[left]), self._ranks(self.second, rank, tokens[following])
                possible[left], possible[p] = new_left, new
                a, b = new_left < _NONE, new < _NONE
                places, ranks = np.concatenate([left[a], p[b]]), np.concatenate([new_left[a], new[b]])
                here = ranks >> BAND == band
                if here.any():
                    for r in np.unique(ranks[here]).tolist():
                        if r not in groups:
                            groups[r] = []
                            heapq.heappush(heap, r)
                        groups[r].append(places[here & (ranks == r)])
                    places, ranks = places[~here], ranks[~here]
                enter(places, ranks)
        return True

    def _as_dicts(self) -> tuple[dict, dict]:
        if self.lists is None:
            made = []
            for offsets, keys, ranks in (self.second, self.before):
                cut, k, r = offsets.tolist(), keys.tolist(), ranks.tolist()
                made.append({own: dict(zip(k[a:b], r[a:b], strict=True)) for own, (a, b) in enumerate(zip(cut, cut[1:], strict=False)) if a < b})
            self.lists = tuple(made)
        return self.lists

    def _singly(self, tokens_: np.ndarray, possible_: np.ndarray) -> np.ndarray:
        """The merges that are left, one position after the other.

        A merge that makes a pair of the same or a lower rank is interrupted for it, so that each word sees
        the order it would see alone: lowest rank first, then leftmost.
        """
        second, first = self._as_dicts()
        places_of = np.flatnonzero(possible_ < _NONE)
        places_of = places_of[np.argsort(possible_[places_of], kind="stable")]
        heap, cuts = np.unique(possible_[places_of], return_index=True)
        heap = heap.tolist()
        index = {r: x.tolist() for r, x in zip(heap, np.split(places_of, cuts[1:]), strict=False)}
        tokens, possible, n = tokens_.tolist(), possible_.tolist(), len(tokens_)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        nothing: dict[int, int] = {}
        while heap:
            rank = heapq.heappop(heap)
            places = index.pop(rank, None)
            if places is None:
                continue
            places.sort()
            with_second, with_before = second.get(rank, nothing).get, first.get(rank, nothing).get
            for k, p in enumerate(places):
                if possible[p] != rank:
                    continue
                q = after[p]
                tokens[p], tokens[q], possible[q] = rank, -2, -1
                q = after[p] = after[q]
                before[q] = p
                lowest, left = rank + 1, before[p]  # before the first word is the last end
                if (r := with_before(tokens[left])) is None:
                    possible[left] = -1
                else:
                    lowest = possible[left] = r
                    if r in index:
                        index[r].append(left)
                    else:
                        index[r] = [left]
                        heapq.heappush(heap, r)
                if (r := with_second(tokens[q])) is None:
                    possible[p] = -1
                else:
                    possible[p] = r
                    if r < lowest:
                        lowest = r
                    if r in index:
                        index[r].append(p)
                    else:
                        index[r] = [p]
                        heapq.heappush(heap, r)
                if lowest <= rank and k + 1 < len(places):
                    if rank not in index:
                        index[rank] = []
                        heapq.heappush(heap, rank)
                    index[rank].extend(places[k + 1 :])
                    break
        return np.array(tokens, np.int32)


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _on_end(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))])


class Words:
    """Cuts chunks into the pattern's words. For the pattern of public byte-level vocabularies the cuts follow
    from the kinds of neighbouring characters; chunks with an apostrophe, and other patterns, are matched."""

    #: Fixed value: that pattern.
    KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, pat: str):
        self.split = pattern(pat)
        self.kinds = None
        if pat == self.KNOWN:
            every = "".join(map(chr, [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]))
            self.kinds = np.full(0x110000, 3, np.uint8)
            for kind, name in ((0, r"\s"), (1, r"\p{L}"), (2, r"\p{N}")):
                self.kinds[np.frombuffer("".join(pattern(f"{name}+").findall(every)).encode("utf-32-le"), "<u4")] = kind

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """First byte of each word of all chunks, in order."""
        if not len(data):
            return np.zeros(0, np.int64)
        raw = data.tobytes()
        matched = np.ones(len(starts) - 1, bool)
        edge = np.zeros(len(data), bool)
        if self.kinds is not None:
            matched[:] = False
            matched[np.searchsorted(starts, np.flatnonzero(data == 0x27), "right") - 1] = True
            # A character is known by its first byte.
            at = np.flatnonzero(data & 0xC0 != 0x80)
            kind = self.kinds[np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")]
            begin = np.zeros(len(at) + 1, bool)
            begin[np.searchsorted(at, starts)] = True
            cut = begin[:-1].copy()
            cut[1:] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0)
            # Of white space before a word the last character is apart, and joins the word if it is a blank.
            last = np.zeros(len(at), bool)
            last[:-1] = (kind[:-1] == 0) & (kind[1:] > 0) & ~begin[1:-1]
            cut |= last
            joins = last & (data[at] == 0x20)
            cut[1:] |= last[:-1] & ~joins[:-1]
            edge[at[cut]] = True
        for i in np.flatnonzero(matched).tolist():
            a, b = int(starts[i]), int(starts[i + 1])
            edge[a:b] = False
            for word in self.split.findall(raw[a:b].decode()):
                edge[a] = True
                a += len(word.encode())
        return np.flatnonzero(edge)


class Encoder:
    """Ids of chunks: of words that are tokens or shared at once, of the others by a replay of all that are new."""

    def __init__(self, path: str, pat: str, replay: Replay):
        ranks = load_ranks(path)
        self.words, self.replay = Words(pat), replay
        self.base, self.own = Table(), Table()
        tokens = [t for t in ranks if t]
        self.learn(self.base, *_on_end(tokens), np.array([ranks[t] for t in tokens], np.uint32), np.ones(len(tokens), np.int64))

    @staticmethod
    def learn(into: Table, data: np.ndarray, starts: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Words on end (of which the table has none) with their ids."""
        keys = hashes_of(data, starts[:-1])
        into.add(*keys, ids, sizes)

    def __call__(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.own.n > OWN:
            self.own = Table()
        first = self.words(data, starts)
        keys = hashes_of(data, first)
        found = self.base.find(*keys)
        new = np.flatnonzero(found < 0)
        mine = self.own.find(keys[0][new], keys[1][new])
        unknown = new[mine < 0]
        if len(unknown):
            _, one, which = np.unique(keys[0][unknown], return_index=True, return_inverse=True)
            if (keys[1][unknown[one]][which] != keys[1][unknown]).any():
                _, one, which = np.unique(np.stack([k[unknown] for k in keys], 1), axis=0, return_index=True, return_inverse=True)
            some = unknown[one]
            sizes = np.append(first[1:], len(data))[some] - first[some]
            ids, n = self.replay(stretches(data, first[some], sizes), np.concatenate([[0], np.cumsum(sizes)]))
            before = self.own.n
            self.own.add(keys[0][some], keys[1][some], ids, n)
            mine[mine < 0] = before + which.ravel()
        size = self.base.size[found]
        size[new] = self.own.size[mine]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids, own = np.empty(int(ends[-1]), np.uint32), np.repeat(found < 0, size)
        ids[own] = self.own.gather(mine)[0]
        ids[~own] = self.base.gather(found[found >= 0])[0]
        return ids, np.diff(ends[np.searchsorted(first, starts)])


def hashes_of(data: np.ndarray, first: np.ndarray, most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """hashes() of a megabyte at a time."""
    ends, out, at = np.append(first[1:], len(data)), (np.empty(len(first), np.uint64), np.empty(len(first), np.uint64)), 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(ends, first[at] + most, "right")))
        out[0][at:to], out[1][at:to] = hashes(data[first[at] : ends[to - 1]], first[at:to] - first[at])
        at = to
    return out


_CODERS: dict[tuple, Chunked] = {}


def coder(path: str, pat: str, model=None) -> Chunked:
    """One for each Python worker: the ids of common chunks stay between tasks. ``model`` is a broadcast of
    (Replay, words, starts, ids, sizes)."""
    key = (path, pat, getattr(model, "_path", None))
    if key not in _CODERS:
        _CODERS.clear()
        replay, *shared = model.value if model is not None else [Replay.of(load_ranks(path))]
        encoder = Encoder(path, pat, replay)
        if shared:
            Encoder.learn(encoder.base, *shared)
        _CODERS[key] = Chunked(encoder, CHUNKS)
    return _CODERS[key]


def corpus_words(docs: DataFrame, path: str, pat: str, text_col: str = "text") -> DataFrame:
    """(word, n): words of two partitions or more that are no token, and of how many."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, single = Words(pat), [t for t in load_ranks(path) if t]

        def begun() -> Table:
            out = Table()
            Encoder.learn(out, *_on_end(single), np.zeros(0, np.uint32), np.zeros(len(single), np.int64))
            return out

        known = [begun()]
        fresh: list[tuple[np.ndarray, np.ndarray]] = []

        def note(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            first = words(data, starts)
            keys = hashes_of(data, first)
            new = np.flatnonzero(known[0].find(*keys) < 0)
            _, one = np.unique(keys[0][new], return_index=True)
            some = new[one]
            sizes = np.append(first[1:], len(data))[some] - first[some]
            if known[0].n > 3 * OWN:
                known[0] = begun()
            known[0].add(keys[0][some], keys[1][some], np.zeros(0, np.uint32), np.zeros(len(some), np.int64))
            fresh.append((stretches(data, first[some], sizes), np.concatenate([[0], np.cumsum(sizes)])))
            return np.zeros(0, np.uint32), np.zeros(len(starts) - 1, np.int64)

        seen = Chunked(note, CHUNKS)
        for frame in frames:
            for a, b in spans(frame.column(0), PART):
                data, starts = text_bytes(frame.column(0).slice(a, b - a))
                if seen.table.n > seen.most_chunks:
                    seen.table = Table()
                first = chunk_starts(data, starts)
                if len(first):
                    seen.entries(data, first)
                for made, at in fresh:
                    yield pa.RecordBatch.from_arrays([binaries(made, at)], ["word"])
                fresh.clear()
        trim()

    return docs.select(text_col).mapInArrow(run, "word binary").groupBy("word").agg(F.count("*").alias("n")).where("n > 1")


def replayed(words: DataFrame, model) -> DataFrame:
    """(word, ids): each partition's words in one replay, ids as little-endian unsigned 32-bit integers."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, held, size = model.value, [], 0

        def flush() -> pa.RecordBatch:
            column = pa.concat_arrays([x.cast(pa.binary()) for x in held])
            ids, sizes = replay(*text_bytes(column))
            return pa.RecordBatch.from_arrays([column, binaries(ids.astype("<u4"), 4 * np.concatenate([[0], np.cumsum(sizes)]))], ["word", "ids"])

        for frame in frames:
            held.append(frame.column(0))
            size += frame.nbytes
            if size > REPLAY:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        trim()

    return words.select("word").mapInArrow(run, "word binary, ids binary")


def corpus_model(docs: DataFrame, path: str, pat: str, text_col: str = "text", most: int | None = None):
    """A broadcast of the replay, and of the most widespread words of up to LONGEST bytes and their ids, ``most`` (SHARED)
    at most."""
    spark = prepare(docs.sparkSession)
    replay = Replay.of(load_ranks(path))
    # A longer word is replayed where it occurs: what is sent has SHARED * LONGEST bytes at most, and their ids.
    counted = stored(corpus_words(docs, path, pat, text_col), "words").where(F.octet_length("word") <= LONGEST)
    sizes, total, least = sorted(((r.n, r["count"]) for r in counted.groupBy("n").count().collect()), reverse=True), 0, None
    for n, count in sizes:
        total += count
        if total > (SHARED if most is None else most):
            break
        least = n
    if least is None:
        return spark.sparkContext.broadcast((replay, np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)))
    made = replayed(counted.where(F.col("n") >= least), spark.sparkContext.broadcast(replay)).toArrow().combine_chunks()
    words, ids = (pa.concat_arrays([x.cast(pa.binary()) for x in made.column(k).chunks]) for k in range(2))
    data, starts = text_bytes(words)
    raw, at = text_bytes(ids)
    return spark.sparkContext.broadcast((replay, data.copy(), starts, np.frombuffer(raw.tobytes(), "<u4"), np.diff(at) // 4))


def encode_documents(docs: DataFrame, path: str, pat: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """(id_col, ids): a row for each row of ``docs``; ids are little-endian unsigned 32-bit integers in a binary.

    With ``decode`` also decoded, the bytes that the ids give. ``path`` names a file of ranks on every executor,
    ``pat`` the pattern that cuts texts into words. Special tokens' strings are ordinary text. A null or empty
    text has empty ids. Repeated rows and null ids are rows as any; other columns of ``docs`` are not read. An
    empty table gives none.
    """
    prepare(docs.sparkSession)
    kind, model = docs.schema[id_col].dataType.simpleString(), corpus_model(docs, path, pat, text_col)
    names = [id_col, "ids", "decoded"] if decode else [id_col, "ids"]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            encode = coder(path, pat, model)
            for a, b in spans(frame.column(1), PART):
                part = frame.slice(a, b - a)
                ids, starts = encode(*text_bytes(part.column(1)))
                ids = binaries(ids.astype("<u4"), 4 * starts)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, decoded(ids, path)] if decode else [part.column(0), ids], names)
            trim()

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decode)


_TOKENS: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes on end, and by id where they start and how many they are (none for an unused id)."""
    if path not in _TOKENS:
        by = sorted((r, t) for t, r in load_ranks(path).items())
        first, sizes = np.zeros(by[-1][0] + 1, np.int64), np.zeros(by[-1][0] + 1, np.int64)
        data, starts = _on_end([t for _, t in by])
        ids = np.array([r for r, _ in by])
        first[ids], sizes[ids] = starts[:-1], np.diff(starts)
        _TOKENS[path] = data, first, sizes
    return _TOKENS[path]


def decoded(ids: pa.Array, path: str) -> pa.Array:
    """The bytes of each row's ids, null for null ids."""
    data, first, sizes = token_bytes(path)
    raw, starts = text_bytes(ids)
    flat = np.frombuffer(raw.tobytes(), "<u4")
    ends = np.concatenate([[0], np.cumsum(sizes[flat])])
    made = binaries(stretches(data, first[flat], sizes[flat]), ends[starts // 4])
    return pc.if_else(ids.is_valid(), made, None) if ids.null_count else made


def decode_documents(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded (binary): the bytes of its ids, null for null ids; a column of that name is replaced."""
    prepare(encoded.sparkSession)
    plain = encoded.drop("decoded")
    at = plain.columns.index(ids_col)
    schema = encoded.drop("decoded").schema.add("decoded", "binary")

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            for a, b in spans(frame.column(at), PART):
                part = frame.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, decoded(part.column(at), path)], schema.fieldNames())
            trim()

    return plain.mapInArrow(run, schema)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pat = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode_documents(table(spark, sf_dir, "documents"), path, pat, decode=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
