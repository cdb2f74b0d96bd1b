"""Byte-level BPE over many texts by merge replay.

The distinct pieces of a batch of texts are one corpus of symbol sequences.  An
inverted index maps each merge, that is each rank of an adjacent symbol pair, to
the places where such a pair stands, and a heap holds the ranks.  The first rank
is merged at all its places at once, and only the neighbours of those places are touched: their new pairs are
entered, their old ones found stale when their turn comes.  A piece's merges do not depend on other
pieces, so the result is the one of merging each piece alone.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import by_bytes

#: Pieces, and bytes of them and their ids, in each of the two generations a worker remembers, but for one part's more.
REMEMBER, REMEMBER_BYTES = 300_000, 16_000_000
#: Pairs whose merge is remembered, but for one part's more.
PAIRS = 1 << 18


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """What two tokens make: the id of their joined bytes, looked up once for each pair met."""

    SHIFT = 20
    #: Stands before and after each piece; it merges with nothing.
    END = (1 << SHIFT) - 1

    def __init__(self, ranks: dict[bytes, int]):
        if max(ranks.values(), default=0) >= self.END:
            raise ValueError(f"ids are below {self.END}")
        self.ranks, self.bytes_of = ranks, {rank: token for token, rank in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: rank of two bytes, at 256 * left + right
        self.two = np.array([ranks.get(bytes([x, y]), -1) for x in range(256) for y in range(256)], np.int64)
        self.made: dict[int, int] = {}

    def look(self, pair: int) -> int:
        """The id that a pair (left << SHIFT | right) makes, -1 if none."""
        left, right = pair >> self.SHIFT, pair & self.END
        made = -1 if self.END in (left, right) else self.ranks.get(self.bytes_of[left] + self.bytes_of[right], -1)
        self.made[pair] = made
        return made


def replay_raw(pieces: list[bytes], merges: Merges) -> tuple[bytes, np.ndarray]:
    """Ids of nonempty pieces, four bytes each, and where each piece's end among them.

    ``turn[at]`` is the rank of the pair that starts at symbol ``at``, and ``index``
    has the places of each rank; a place whose pair has changed since it was
    entered is passed over.  A merge may open a pair of an earlier rank; then the
    later places of that piece wait until that pair has had its turn.
    """
    shift, end, made, look = merges.SHIFT, merges.END, merges.made, merges.look
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    raw = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
    # an END, then each piece and an END after it
    starts = np.cumsum(sizes + 1) - sizes
    at = np.arange(len(raw)) + np.repeat(np.arange(1, len(pieces) + 1), sizes)
    symbols = np.full(len(raw) + len(pieces) + 1, end, np.int64)
    symbols[at] = merges.single[raw]
    ranks = np.full(len(symbols), -1, np.int64)
    inner = np.flatnonzero(np.diff(at) == 1)
    ranks[at[inner]] = merges.two[256 * raw[inner] + raw[inner + 1]]
    places = np.flatnonzero(ranks >= 0)
    places = places[np.argsort(ranks[places], kind="stable")]
    first = np.flatnonzero(np.diff(ranks[places], prepend=-1))
    index = {r: p.tolist() for r, p in zip(ranks[places[first]].tolist(), np.split(places, first[1:]))} if len(places) else {}
    heap = sorted(index)
    symbol, turn = symbols.tolist(), ranks.tolist()
    left, right = list(range(-1, len(symbol) - 1)), list(range(1, len(symbol) + 1))
    push, pop = heapq.heappush, heapq.heappop

    def piece_end(at: int) -> int:
        k = int(np.searchsorted(starts, at, side="right")) - 1
        return int(starts[k] + sizes[k])

    while heap:
        rank = pop(heap)
        places = index.pop(rank)
        if len(places) > 1:
            places.sort()  # from the left, as overlapping places of one piece are merged
        waits, later = 0, []
        for at in places:
            if turn[at] != rank:
                continue
            if at < waits:
                later.append(at)
                continue
            to = right[at]
            after, before = right[to], left[at]
            symbol[at], symbol[to], turn[to] = rank, -1, -1
            right[at], left[after] = after, at
            new = rank << shift | symbol[after]
            opened = made.get(new)
            if opened is None:
                opened = look(new)
            turn[at] = opened
            if opened >= 0:
                entered = index.get(opened)
                if entered is None:
                    index[opened] = [at]
                    push(heap, opened)
                else:
                    entered.append(at)
                if opened < rank:
                    waits = piece_end(at)
            new = symbol[before] << shift | rank
            opened = made.get(new)
            if opened is None:
                opened = look(new)
            turn[before] = opened
            if opened >= 0:
                entered = index.get(opened)
                if entered is None:
                    index[opened] = [before]
                    push(heap, opened)
                else:
                    entered.append(before)
                if opened < rank:
                    waits = piece_end(at)
        if later:
            index[rank] = later
            push(heap, rank)
    symbols = np.array(symbol, np.int64)
    kept = symbols >= 0
    kept[symbols == end] = False
    ends = np.cumsum(kept)[starts + sizes - 1] if len(pieces) else sizes
    return symbols[kept].astype("<u4").tobytes(), ends


def replay(pieces: Iterable[bytes], merges: Merges) -> dict[bytes, bytes]:
    """Ids of each distinct piece, by replaying merges over all of them; a piece that is a token stays one."""
    distinct = list(dict.fromkeys(pieces))
    done = {p: merges.ranks[p].to_bytes(4, "little") if p in merges.ranks else b"" for p in distinct}
    rest = [p for p in distinct if p and p not in merges.ranks]
    if rest:
        raw, ends = replay_raw(rest, merges)
        stops = (4 * ends).tolist()
        done.update((p, raw[s:e]) for p, s, e in zip(rest, [0, *stops], stops))
    return done


class Encoder:
    """Encodes and decodes texts by one rank file; pieces once replayed are remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.merges, self.find = Merges(ranks), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.held = 0  # bytes of the known pieces and their ids

    def learn(self, pieces: set[str]) -> None:
        new = pieces - self.known.keys()
        again = new & self.older.keys()
        new -= again
        encoded = {p.encode(): p for p in new}
        found = {p: self.older[p] for p in again} | {encoded[b]: ids for b, ids in replay(encoded, self.merges).items()}
        self.known.update(found)
        self.held += sum(map(len, found)) + sum(map(len, found.values()))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.find(t) for t in texts]
        if len(self.known) > REMEMBER or self.held > REMEMBER_BYTES:
            self.known, self.older, self.held = {}, self.known, 0
        if len(self.merges.made) > PAIRS:
            self.merges.made.clear()
        self.learn(set().union(*found))
        known = self.known
        return [b"".join([known[p] for p in pieces]) for pieces in found]

    def decode(self, ids: bytes) -> bytes:
        token = self.merges.bytes_of
        return b"".join([token[i] for i in memoryview(ids).cast("I")])


#: The encoder a Python worker keeps from task to task, under its key; never more than one.
_kept: dict[str, Encoder] = {}


def worker_encoder(key: str, ranks, pattern: str) -> Encoder:
    if key not in _kept:
        _kept.clear()
        _kept[key] = Encoder(ranks.value, pattern)
    return _kept[key]


#: Bytes of text replayed as one corpus, but for a single longer text.
TOGETHER = 400_000


def encoded(batches: Iterable[pa.RecordBatch], encoder: Encoder, full: bool = False) -> Iterator[pa.RecordBatch]:
    """Batches of (doc_id, text) to what ``encode_decode`` returns of each row."""
    for part in by_bytes(batches, "text", TOGETHER):
        rows: list[tuple] = []
        for ids in encoder.encode([t or "" for t in part.column("text").to_pylist()]):
            text = encoder.decode(ids)
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text).hexdigest(), *((list(memoryview(ids).cast("I")), text) if full else ())))
        kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.binary()]
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 1 + len(cols)])


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", full: bool = False) -> DataFrame:
    """A row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no tokens.  Null ids and repeated rows keep a row
    each; only the two named columns are read.  With ``full`` the ids (array) and
    the decoded bytes are returned too.  The rank file is read on the driver and
    its table, of a size fixed by the file, is sent to the executors.
    """
    table = load_ranks(path)
    ranks = docs.sparkSession.sparkContext.broadcast(table)
    key = hashlib.sha256(repr((sorted(table.items()), pattern)).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches, worker_encoder(key, ranks, pattern), full)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    more = ", ids array<long>, decoded binary" if full else ""
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string{more}")
