"""Removal of repeated substrings: column-wise construction of multi-string suffix order.

A byte goes if some 50-byte string that covers it also starts in a document with a smaller doc_id.

1. Chunks. Each input partition packs its texts into compressed chunks, written once in shared storage.
2. Anchors. The anchor of a 50-byte window is the least hash among its 27 grams of 24 bytes, so equal windows have
   equal anchors. Each chunk sends every distinct anchor once, by ranges of anchors; an anchor that two documents
   have is shared. Windows whose anchor isn't shared cannot repeat and are done with.
3. Suffix order. Neighbouring windows of one shared anchor form a string of at most 76 bytes. A chunk sends each
   string once, with its smallest doc_id, and all strings of some anchors, from all chunks, are one collection, cut into
   symbols of ten bytes at each of the ten phases. Its Burrows-Wheeler transform and longest common prefixes are
   built column by column: each round inserts one symbol of every string, right to left, at the place that the rank of
   the symbol gives. The transform is kept as its occurrence list, the ascending (symbol, place) pairs, where a rank is a
   search. Suffixes with common prefixes of five symbols or more are equal windows; the smallest doc_id of each goes
   back to the chunks that have larger ones. Nothing else finds what repeats between chunks.
4. Removal. Each chunk marks the covered bytes of its documents.

Column-wise construction takes one round for each symbol of the longest string, so it cannot run over whole texts (a
hundred thousand rounds over all that is there); over strings around shared anchors it takes seven rounds, whatever the texts'
lengths. A collection has about STRINGS strings, so its columns stay in memory, and the sequential external files
are the sorted shuffle files that the strings come in by. An anchor that very many chunks share would make one
collection large; its windows travel one by one, dealt out by their own hash instead, and are one string for each chunk
at most.

Defined cases: null counts as empty; rows with a null doc_id have no place in the order, so they lose nothing and
take nothing; rows that repeat a doc_id take nothing from each other; texts under 50 bytes stay whole; very long
texts are hashed slice by slice; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, power_of_two, released, trimmed

WINDOW, GRAM = 50, 24
GRAMS = WINDOW - GRAM + 1
#: Bytes of a symbol, and symbols of a window.
SYMBOL, DEPTH = 10, 5
#: Windows of one string, and so its longest length.
RUN = GRAMS
WIDTH = WINDOW + RUN - 1
ANCHOR_BITS = 48
#: Bytes of text in a chunk, and in a slice that is hashed at once (its arrays should stay in a core's cache).
CHUNK, SLICE = 4 << 20, 1 << 15
#: Bytes of text for each range of anchors.
RANGE_BYTES, LEAST_RANGES = 8 << 20, 64
#: An anchor that more chunks share is dealt out window by window.
HOT_CHUNKS = 64
#: Strings of a collection, about; those of one anchor stay together.
STRINGS = 1000
NEVER = np.iinfo(np.int64).max
_RANDOM = np.random.default_rng(9).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _pressed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, those of each place together."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _opened(data: bytes, *kinds: type) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n, at, out = len(raw) // sum(np.dtype(k).itemsize for k in kinds), 0, []
    for k in kinds:
        size = np.dtype(k).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(k).reshape(n))
        at += n * size
    return out


def _ascending(values: np.ndarray) -> bytes:
    return _pressed(np.diff(values, prepend=np.uint64(0)))


def _summed(data: bytes) -> np.ndarray:
    return np.cumsum(_opened(data, np.uint64)[0], dtype=np.uint64)


# Chunks ----------------------------------------------------------------------------------------------------------


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze, part, k = zstandard.ZstdCompressor(level=6), TaskContext.get().partitionId(), 0
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = 0

    def out() -> pa.RecordBatch:
        lengths = np.array([len(t) for t in texts], np.int64)
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | k]), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tobytes()], pa.binary()), pa.array([squeeze.compress(b"".join(texts))], pa.binary())], names=["chunk", "ids", "lengths", "data"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary())):
            text = text.as_py() or b""
            if texts and size + len(text) > CHUNK:
                yield out()
                ids, texts, size, k = [], [], 0, k + 1
            ids.append(doc_id)
            texts.append(text)
            size += len(text)
    if texts:
        yield out()


@dataclass
class Chunk:
    ids: list[int | None]
    starts: np.ndarray  # of the documents, and the end of the last
    data: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        lengths = np.frombuffer(row["lengths"], np.int64)
        return cls(row["ids"], np.r_[0, np.cumsum(lengths)], np.frombuffer(zstandard.ZstdDecompressor().decompress(row["data"]), np.uint8))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows with one anchor: first and last window, anchor, doc_id."""
        n = len(self.data)
        valid = np.zeros(n + 1, bool)
        for k, (a, b) in enumerate(zip(self.starts[:-1].tolist(), self.starts[1:].tolist())):
            if self.ids[k] is not None and b - a >= WINDOW:
                valid[a : b - WINDOW + 1] = True
        found = []
        for a in range(0, n - WINDOW + 1, SLICE):
            b = min(a + SLICE, n - WINDOW + 1)
            anchors = _anchors(self.data[a : b + WINDOW - 1])
            ok = valid[a:b]
            first = ok.copy()
            first[1:] &= (anchors[1:] != anchors[:-1]) | ~ok[:-1]
            last = ok.copy()
            last[:-1] &= (anchors[1:] != anchors[:-1]) | ~ok[1:]
            left, right = np.flatnonzero(first), np.flatnonzero(last)
            found.append((left + a, right + a, anchors[left]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none.astype(np.uint64), none
        left, right, anchor = (np.concatenate(x) for x in zip(*found))
        anchor = (anchor * _STEPS[0]) & np.uint64((1 << ANCHOR_BITS) - 1)  # least hashes are small; their ranges should be even
        ids = np.array([NEVER if x is None else x for x in self.ids], np.int64)
        return left, right, anchor, ids[np.searchsorted(self.starts, left, side="right") - 1]


def _anchors(x: np.ndarray) -> np.ndarray:
    """Of each window of x (along its last axis), the least of its grams' hashes."""
    h = _RANDOM[x]
    for size, step in zip((1, 2, 4, 8), _STEPS):
        eight = h  # grams of eight bytes in the last turn
        low = h[..., :-size] * step
        low += h[..., size:]
        low ^= low >> np.uint64(29)
        h = low
    h = h[..., :-8] * _STEPS[4]  # sixteen bytes and the next eight
    h += eight[..., 16:]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h >>= np.uint64(64 - ANCHOR_BITS)
    for size in (1, 2, 4, 8):
        h = np.minimum(h[..., :-size], h[..., size:])
    return np.minimum(h[..., : -(GRAMS - 16)], h[..., GRAMS - 16 :])  # sixteen grams, and the same eleven further on


# Shared anchors ---------------------------------------------------------------------------------------------------


def _anchor_rows(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, _, anchor, doc = Chunk.of(row).runs()
                if not len(anchor):
                    continue
                order = np.argsort(anchor, kind="stable")
                anchor, doc = anchor[order], doc[order]
                at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
                many = np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)
                values = (anchor[at] << np.uint64(1)) | many.astype(np.uint64)
                yield _dealt(row["chunk"], values, bits)

    return run


def _dealt(chunk: int, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Ascending anchors with a flag bit, cut into ranges."""
    spot = (values >> np.uint64(ANCHOR_BITS + 1 - bits)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, spot[1:] != spot[:-1]])
    parts = [_ascending(values[a:b]) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(values)])]
    return pa.RecordBatch.from_arrays([pa.array(spot[at].astype(np.int32)), pa.array(np.full(len(at), chunk)), pa.array(parts, pa.binary())], names=["range", "chunk", "data"])


def _shared(rows: pa.Table) -> pa.Table:
    chunks = rows["chunk"].to_numpy()
    lists = [_summed(d.as_py()) for d in rows["data"]]
    owner = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    values = np.concatenate(lists)
    anchor, many = values >> np.uint64(1), values & np.uint64(1)
    _, back, count = np.unique(anchor, return_inverse=True, return_counts=True)
    several = np.bincount(back, many) > 0
    keep = (several | (count > 1))[back]
    marked = (anchor << np.uint64(1)) | (count > HOT_CHUNKS)[back].astype(np.uint64)
    out_chunk, out = [], []
    marked, owner = marked[keep], owner[keep]
    order = np.lexsort((marked, owner))
    marked, owner = marked[order], owner[order]
    for a, b in zip(*_bounds(owner)):
        out_chunk.append(int(chunks[owner[a]]))
        out.append(_ascending(marked[a:b]))
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "range": pa.array([-1] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})


def _bounds(sorted_values: np.ndarray) -> tuple[list[int], list[int]]:
    if not len(sorted_values):
        return [], []
    at = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return at.tolist(), [*at[1:].tolist(), len(sorted_values)]


# Strings ----------------------------------------------------------------------------------------------------------


@dataclass
class Strings:
    """The pieces of a chunk whose anchors are shared, and the distinct strings they are."""

    left: np.ndarray  # first window of each piece
    windows: np.ndarray
    doc: np.ndarray
    which: np.ndarray  # the piece's string
    rows: np.ndarray  # distinct strings, padded to WIDTH, and their lengths
    least: np.ndarray  # smallest doc_id of each string
    spot: np.ndarray  # range of each string

    @classmethod
    def of(cls, chunk: Chunk, marked: np.ndarray, bits: int) -> Strings:
        left, right, anchor, doc = chunk.runs()
        at = np.searchsorted(marked, anchor << np.uint64(1))
        at = np.minimum(at, len(marked) - 1)
        own = (marked[at] >> np.uint64(1)) == anchor
        left, right, anchor, doc, hot = left[own], right[own], anchor[own], doc[own], (marked[at[own]] & np.uint64(1)) == 1
        most = np.where(hot, 1, RUN)
        pieces = (right - left) // most + 1
        run = np.repeat(np.arange(len(left)), pieces)
        k = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = left[run] + k * most[run]
        windows = np.minimum(most[run], right[run] - first + 1)
        length = windows + WINDOW - 1
        padded = np.concatenate([chunk.data, np.zeros(WIDTH, np.uint8)])
        text = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[first].copy()
        text[np.arange(WIDTH)[None, :] >= length[:, None]] = 0
        rows = np.concatenate([text, length[:, None].astype(np.uint8)], axis=1)
        rows, which = _distinct(rows)
        least = np.full(len(rows), NEVER)
        np.minimum.at(least, which, doc[run])
        spot = np.zeros(len(rows), np.int64)
        spot[which] = (anchor[run] >> np.uint64(ANCHOR_BITS - bits)).astype(np.int64)
        alone = np.zeros(len(rows), bool)
        alone[which] = hot[run]
        lone = np.flatnonzero(alone)
        mixed = (rows[lone, :WINDOW].astype(np.uint64) * _RANDOM[None, :WINDOW]).sum(axis=1, dtype=np.uint64)
        mixed ^= mixed >> np.uint64(31)
        spot[lone] = ((mixed * _STEPS[1]) >> np.uint64(64 - bits)).astype(np.int64)
        return cls(first, windows, doc[run], which, rows, least, spot)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and which of them each row is: by a hash of the whole row, compared with the rows themselves."""
    if not len(rows):
        return rows, np.zeros(0, np.int64)
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for k in range(words.shape[1]):
        h = (h ^ words[:, k]) * _STEPS[k % len(_STEPS)]
        h ^= h >> np.uint64(29)
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    if (words[first[back]] == words).all():
        return rows[first], back
    kinds, back = np.unique(np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel(), return_inverse=True)
    return kinds.view(np.uint8).reshape(len(kinds), rows.shape[1]), back


def _string_rows(bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        spots, parts, chunk = [], [], None
        if left.num_rows and right.num_rows:
            row = left.to_pylist()[0]
            chunk = row["chunk"]
            strings = Strings.of(Chunk.of(row), np.sort(np.concatenate([_summed(d.as_py()) for d in right["data"]])), bits)
            order = np.argsort(strings.spot, kind="stable")
            for a, b in zip(*_bounds(strings.spot[order])):
                own = order[a:b]
                spots.append(int(strings.spot[own[0]]))
                parts.append(_packed(strings.least[own], strings.rows[own]))
        return pa.table({"range": pa.array(spots, pa.int32()), "chunk": pa.array([chunk] * len(spots), pa.int64()), "data": pa.array(parts, pa.binary())})

    return run


def _packed(least: np.ndarray, rows: np.ndarray) -> bytes:
    """Numbers by place, then the strings one after another."""
    length = rows[:, WIDTH]
    numbers = np.ascontiguousarray(least).view(np.uint8).reshape(-1, 8).T.tobytes()
    text = rows[:, :WIDTH][np.arange(WIDTH)[None, :] < length[:, None]].tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(rows).to_bytes(8, "little") + numbers + length.tobytes() + text)


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(raw[:8], "little")
    least = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n).T).view(np.int64).ravel()
    length = np.frombuffer(raw, np.uint8, n, 8 + 8 * n)
    rows = np.zeros((n, WIDTH + 1), np.uint8)
    rows[:, WIDTH] = length
    rows[:, :WIDTH][np.arange(WIDTH)[None, :] < length[:, None]] = np.frombuffer(raw, np.uint8, -1, 8 + 9 * n)
    return least, rows


# Suffix order -------------------------------------------------------------------------------------------------------


def _levels(values: np.ndarray) -> np.ndarray:
    """Row k: from each place on, the least of 2^k values (as far as there are so many)."""
    out = np.empty((max(1, len(values).bit_length()), len(values)), np.uint8)
    out[0] = values
    for k in range(1, len(out)):
        size = 1 << (k - 1)
        np.minimum(out[k - 1, :-size], out[k - 1, size:], out=out[k, :-size])
    return out


def _least_between(levels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each range [a, b), the least value."""
    k = np.frexp((b - a).astype(np.float32))[1].astype(np.int64) - 1
    k -= (np.int64(1) << k) > b - a  # a float may have been rounded up
    row = k * levels.shape[1]
    flat = levels.ravel()
    return np.minimum(flat[row + a], flat[row + b - (np.int64(1) << k)])


class Columns:
    """Burrows-Wheeler transform and longest common prefixes of a collection of symbol strings, built column by column.

    Suffixes are in ascending order; ends sort first, by string. `pairs` has one entry for each suffix that isn't empty:
    its first symbol and the place of the rest, ascending, which is the list of the places where each symbol stands in the
    transform. `lcp` is the number of symbols that a suffix shares with the one before it.
    """

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        """symbols: a row for each string, of numbers below 2^40."""
        m, n = len(lengths), int(lengths.sum()) + len(lengths)
        self.m, self.shift = m, np.uint64(max(1, n.bit_length()))
        if 40 + int(self.shift) > 64:  # too many places beside such symbols: their ranks are smaller
            symbols = np.unique(symbols, return_inverse=True)[1].reshape(symbols.shape).astype(np.uint64)
        mask = (np.uint64(1) << self.shift) - np.uint64(1)
        self.pairs, self.lcp = np.zeros(0, np.uint64), np.zeros(m, np.uint8)
        ids = np.argsort(-lengths, kind="stable")  # those still growing come first
        at, left = ids.astype(np.uint64), lengths[ids]
        for j in range(1, int(lengths.max(initial=0)) + 1):
            on = int(np.searchsorted(-left, -j, side="right"))
            ids, at, left = ids[:on], at[:on], left[:on]
            fresh = (symbols[ids, left - j] << self.shift) | at
            order = np.argsort(fresh, kind="stable")
            fresh = fresh[order]
            where = np.searchsorted(self.pairs, fresh)
            places = where + np.arange(on)
            old = len(self.pairs)
            moved = np.cumsum(np.bincount(where, minlength=old + 1)[:old])  # new suffixes before each old one
            kept = np.arange(old) + moved
            both = np.empty(old + on, np.uint64)
            both[kept], both[places] = self.pairs, fresh
            lcp = np.zeros(m + old + on, np.uint8)
            lcp[:m], lcp[m + kept] = self.lcp[:m], self.lcp[m:]
            # prefixes change where a suffix or the one before it is new
            near = np.zeros(old + on + 1, bool)
            near[places] = near[places + 1] = True
            near[0] = False
            q = np.flatnonzero(near[: old + on])
            same = (both[q] >> self.shift) == (both[q - 1] >> self.shift)
            lcp[m + q[~same]] = 0
            q = q[same]
            low, high = (both[q - 1] & mask).astype(np.int64), (both[q] & mask).astype(np.int64)
            lcp[m + q] = _least_between(_levels(self.lcp), low + 1, high + 1) + np.uint8(1)
            # the places that the pairs name have moved, too
            shifted = np.zeros(m + old, np.uint64)
            shifted[m:] = moved
            both += shifted[(both & mask).astype(np.int64)]
            self.pairs, self.lcp = both, lcp
            at = np.empty(on, np.uint64)
            at[order] = (m + places).astype(np.uint64)

    def rests(self) -> np.ndarray:
        """Of each suffix that isn't empty, the place of the one a symbol shorter."""
        return (self.pairs & ((np.uint64(1) << self.shift) - np.uint64(1))).astype(np.int64)

    def transform(self) -> np.ndarray:
        """Of each suffix, the symbol before it plus one, or 0 if it is a whole string."""
        out = np.zeros(len(self.lcp), np.uint64)
        out[self.rests()] = (self.pairs >> self.shift) + np.uint64(1)
        return out


def least_of_windows(rows: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each string (row: WIDTH bytes, length) and each of its windows, the smallest `least` of a string that has an
    equal window; NEVER beyond the last window."""
    lengths = rows[:, WIDTH].astype(np.int64)
    text = rows[:, :WIDTH].astype(np.uint64)
    half = SYMBOL // 2
    grams = np.zeros((len(rows), WIDTH - half + 1), np.uint64)
    for k in range(half):
        grams = (grams << np.uint64(8)) | text[:, k : WIDTH - half + 1 + k]
    # halves by number, in any order, so that a symbol's two fit in a word
    coded = pa.array(grams.ravel()).dictionary_encode()
    number, bits = coded.indices.to_numpy().reshape(grams.shape).astype(np.uint64), len(coded.dictionary).bit_length()
    grams = (number[:, :-half] << np.uint64(bits)) | number[:, half:]
    if 2 * bits > 40:
        grams = np.unique(grams, return_inverse=True)[1].reshape(grams.shape).astype(np.uint64)
    string, phase = np.nonzero(np.arange(SYMBOL)[None, :] <= (lengths - WINDOW)[:, None])  # phases at which a window begins
    count = (lengths[string] - phase) // SYMBOL
    columns = np.arange(int(count.max(initial=0)))
    symbols = grams[string[:, None], np.minimum(phase[:, None] + SYMBOL * columns, WIDTH - SYMBOL)]
    built = Columns(symbols, count)
    onward = np.empty(len(built.lcp), np.int64)
    onward[built.rests()] = built.m + np.arange(len(built.pairs))  # of a suffix, the place of the one a symbol longer
    low = np.full(len(built.lcp), NEVER)
    at, spots = np.arange(built.m), []
    for j in range(1, len(columns) + 1):
        own = np.flatnonzero(count >= j)
        at[own] = onward[at[own]]
        if j >= DEPTH:
            low[at[own]] = least[string[own]]
            spots.append((own, phase[own] + SYMBOL * (count[own] - j), at[own]))
    starts = np.flatnonzero(built.lcp < DEPTH)
    lowest = np.minimum.reduceat(low, starts) if len(starts) else low
    group = np.cumsum(built.lcp < DEPTH) - 1
    out = np.full((len(rows), RUN), NEVER)
    for own, window, place in spots:
        out[string[own], window] = lowest[group[place]]
    return out


def _collections(rows: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the strings of each collection: all of some anchors."""
    anchor = np.empty(len(rows), np.uint64)
    for a in range(0, len(rows), SLICE):
        anchor[a : a + SLICE] = _anchors(rows[a : a + SLICE, :WINDOW])[:, 0]
    order = np.argsort(anchor, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(anchor[order])) + 1, len(order))  # of the anchors
    at = 0
    while at < len(order):
        end = int(ends[np.searchsorted(ends, min(at + STRINGS, len(order)))])
        yield order[at:end]
        at = end


def _resolve(rows: pa.Table) -> pa.Table:
    chunks, opened = rows["chunk"].to_pylist(), [_unpacked(d.as_py()) for d in rows["data"]]
    least = np.concatenate([x[0] for x in opened])
    owner = np.repeat(np.arange(len(opened)), [len(x[0]) for x in opened])
    local = np.concatenate([np.arange(len(x[0])) for x in opened])
    strings = np.concatenate([x[1] for x in opened])
    del opened
    found = np.full((len(strings), RUN), NEVER)
    for own in _collections(strings):
        found[own] = least_of_windows(strings[own], least[own])
    spot, out_chunk, out = rows["range"][0].as_py(), [], []
    for k, chunk in enumerate(chunks):
        own = np.arange(np.searchsorted(owner, k), np.searchsorted(owner, k + 1))
        table = found[own]
        below = table < least[own][:, None]
        first = below.copy()
        first[:, 1:] &= ~below[:, :-1] | (table[:, 1:] != table[:, :-1])
        last = below.copy()
        last[:, :-1] &= ~below[:, 1:] | (table[:, 1:] != table[:, :-1])
        r, a = np.nonzero(first)
        b = np.nonzero(last)[1]
        if len(r):
            out_chunk.append(chunk)
            out.append(_pressed(table[r, a], local[own][r].astype(np.uint32), a.astype(np.uint8), b.astype(np.uint8)))
    return pa.table({"chunk": pa.array(out_chunk, pa.int64()), "range": pa.array([spot] * len(out), pa.int32()), "data": pa.array(out, pa.binary())})


# Removal ----------------------------------------------------------------------------------------------------------


def _covered(chunk: Chunk, marked: np.ndarray, answers: dict[int, bytes], bits: int) -> np.ndarray:
    change = np.zeros(len(chunk.data) + 1, np.int32)
    if len(marked):
        s = Strings.of(chunk, marked, bits)
        later = s.doc > s.least[s.which]
        np.add.at(change, s.left[later], 1)
        np.add.at(change, s.left[later] + s.windows[later] + WINDOW - 1, -1)
        by_string = np.argsort(s.which, kind="stable")
        count = np.bincount(s.which, minlength=len(s.rows))
        begin = np.cumsum(count) - count
        by_spot = np.argsort(s.spot, kind="stable")
        spots = {int(s.spot[by_spot[a]]): by_spot[a:b] for a, b in zip(*_bounds(s.spot[by_spot]))}
        for spot, data in answers.items():
            low, local, a, b = _opened(data, np.int64, np.uint32, np.uint8, np.uint8)
            string = spots[spot][local]
            times = count[string]
            entry = np.repeat(np.arange(len(string)), times)
            piece = by_string[np.repeat(begin[string] - (np.cumsum(times) - times), times) + np.arange(len(entry))]
            on = s.doc[piece] > low[entry]
            piece, entry = piece[on], entry[on]
            np.add.at(change, s.left[piece] + a[entry], 1)
            np.add.at(change, s.left[piece] + b[entry] + WINDOW, -1)
    return np.cumsum(change[:-1]) > 0


def _remove(bits: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
        for row in left.to_pylist():
            chunk = Chunk.of(row)
            marked, answers = [np.zeros(0, np.uint64)], {}
            for spot, data in zip(right["range"].to_pylist(), right["data"]):
                if spot < 0:
                    marked.append(_summed(data.as_py()))
                else:
                    answers[spot] = data.as_py()
            gone = _covered(chunk, np.sort(np.concatenate(marked)), answers, bits)
            for doc_id, a, b in zip(chunk.ids, chunk.starts[:-1].tolist(), chunk.starts[1:].tolist()):
                own = gone[a:b]
                out["doc_id"].append(doc_id)
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int(own.sum()))
                out["n_spans"].append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                out["kept"].append(chunk.data[a:b][~own].tobytes())
        return pa.table({k: pa.array(v, pa.binary() if k == "kept" else pa.int64()) for k, v in out.items()})

    return run


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    space = Workspace(spark, "suffix")
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    chunks = space.write(rows.mapInArrow(released(_chunked), "chunk long, ids array<long>, lengths binary, data binary"), "chunks", "none")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = (power_of_two(max(LEAST_RANGES, total / RANGE_BYTES))).bit_length() - 1
    dealt = "range int, chunk long, data binary"
    back = "chunk long, range int, data binary"
    anchors = chunks.mapInArrow(released(_anchor_rows(bits)), dealt)
    shared = space.write(anchors.groupBy("range").applyInArrow(trimmed(_shared), back), "shared", "none")
    strings = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(trimmed(_string_rows(bits)), dealt)
    answers = space.write(strings.groupBy("range").applyInArrow(trimmed(_resolve), back), "answers", "none")
    return chunks.groupBy("chunk").cogroup(shared.unionByName(answers).groupBy("chunk")).applyInArrow(trimmed(_remove(bits)), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(kept: str = "kept") -> F.Column:
    return F.sha2(F.col(kept), 256)


__all__ = ["Columns", "dedup", "digest", "least_of_windows"]
