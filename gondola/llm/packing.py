"""Packing along a space-filling curve.

A document's tokens, hashed into a few dimensions by a fixed random projection and averaged, give a point; the
point's place on a Hilbert curve is its key. Documents are range-partitioned and sorted by (key, doc_id), so that
like documents are neighbours and copies with one key still spread over partitions; each partition then fills
sequences with neighbouring documents, cutting a document where a sequence ends. Only the last, unfinished sequence
of a partition is left: it is cut into sequences whose lengths are powers of two, which need no padding.

Tokenizing runs once: its result (compressed ids) is a written table, which the range sort samples and reads.
Ids are those of the tokenizer file, special tokens in a text included. A second, faster implementation builds the same
vocabulary from that file; the driver compares both on a probe and falls back to the file's own tokenizer should they
differ, and the tests compare them on every assigned code point.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as often as they come; rows with a
null doc_id are packed too; very long texts span many sequences; extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, in_slices, released

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END_ID = 0
DIMENSIONS, CURVE_BITS = 4, 12
#: The cube that the curve fills: token means lie well inside.
HALF_SIDE = 1.5
#: Characters tokenized at once.
SLICE = 500_000
#: Tokens of a partition of the packing step: the least worth a task, and the most before more tasks than usual are made.
LEAST_TOKENS, MOST_TOKENS = 1_500_000, 64_000_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_PROBE = "Words, ça 12's\n\n  x<|endoftext|>\t\u4f60 \U0001f600 it's-O'Neil 3.14 \u00a0end\nNext\n\nline."


def _own(path: str) -> Callable[[str], np.ndarray]:
    """The file's tokenizer."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def _fast(path: str) -> Callable[[str], np.ndarray]:
    """The second implementation."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the vocabulary writes as themselves
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): k for token, k in model["model"]["vocab"].items() if token not in special}
    both = tiktoken.Encoding("fast", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    return lambda text: both.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)


def agrees(path: str) -> bool:
    """Whether the second implementation gives the ids of the file's tokenizer on a probe."""
    return _fast(path)(_PROBE).tolist() == _own(path)(_PROBE).tolist()


@lru_cache(maxsize=1)
def encoder(path: str, fast: bool) -> Callable[[str], np.ndarray]:
    """Ids of a text as little-endian unsigned 32-bit integers."""
    return (_fast if fast else _own)(path)


@lru_cache(maxsize=1)
def _projection() -> np.ndarray:
    return np.random.default_rng(20).standard_normal((1 << 16, DIMENSIONS)).astype(np.float32)


def point(ids: np.ndarray) -> np.ndarray:
    """Mean of the hashed tokens' directions."""
    table, total = _projection(), np.zeros(DIMENSIONS)
    for a in range(0, len(ids), 1 << 17):
        total += table[ids[a : a + (1 << 17)] & 0xFFFF].sum(axis=0, dtype=np.float64)
    return total / max(1, len(ids))


def hilbert(points: np.ndarray, bits: int = CURVE_BITS, half: float = HALF_SIDE) -> np.ndarray:
    """Place of each point (rows) on the curve through the cube [-half, half)^d, after Skilling's transpose form."""
    n, d = points.shape
    x = [c.astype(np.int64) for c in np.clip((points + half) / (2 * half) * (1 << bits), 0, (1 << bits) - 1).T]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, d):
        x[i] = x[i] ^ x[i - 1]
    t, q = np.zeros(n, np.int64), 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros(n, np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def _tokenize(path: str, fast: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, squeeze = encoder(path, fast), zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part in in_slices(list(zip(*(c.to_pylist() for c in batch.columns))), lambda r: len(r[1] or "") + 1, SLICE):
                ids = [np.append(x, np.uint32(END_ID)).astype("<u4", copy=False) for x in (encode(t or "") for _, t in part)]
                keys = hilbert(np.array([point(x) for x in ids]))
                yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array(keys), pa.array([len(x) for x in ids], pa.int64()), pa.array([squeeze.compress(_narrow(x)) for x in ids], pa.binary())], names=["doc_id", "curve", "doc_tokens", "ids"])

    return released(run)


def _narrow(ids: np.ndarray) -> bytes:
    """The low bytes of all ids, then the next, and so on: they compress better apart."""
    return ids.view(np.uint8).reshape(-1, 4).T.tobytes()


def _widen(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Filler:
    """Fills sequences in order; pieces: (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, length: int, first: int):
        self.length, self.sequence, self.at, self.open = length, first, 0, []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        start = 0
        while start < len(ids):
            part = ids[start : start + self.length - self.at]
            self.open.append((doc_id, start, part, len(ids), self.sequence, self.at))
            start, self.at = start + len(part), self.at + len(part)
            if self.at == self.length:
                yield from self.open
                self.sequence, self.at, self.open = self.sequence + 1, 0, []

    def rest(self) -> Iterator[tuple]:
        """What has not filled a sequence, in sequences of powers of two."""
        left, pieces = self.at, self.open
        self.open, self.at = [], 0
        room = used = 0
        for doc_id, start, ids, total, *_ in pieces:
            while len(ids):
                if used == room:
                    if room:
                        self.sequence += 1
                    room, used = 1 << (left.bit_length() - 1), 0
                    left -= room
                part, ids = ids[: room - used], ids[room - used :]
                yield doc_id, start, part, total, self.sequence, used
                start, used = start + len(part), used + len(part)


def _pack(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = Filler(length, TaskContext.get().partitionId() << 40)
        expand = zstandard.ZstdDecompressor()
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            doc_id, start, ids, total, sequence, offset = zip(*held)
            columns = {"doc_id": pa.array(doc_id, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()), "doc_tokens": pa.array(total, pa.int64()), "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64())}
            if with_ids:
                columns["ids"] = pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                held += fill.add(doc_id, _widen(expand.decompress(data.as_py())))
                if len(held) > 4096:
                    yield out()
                    held = []
        held += fill.rest()
        if held:
            yield out()

    return released(run)


def pack(spark: SparkSession, docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked, ids.

    docs: doc_id, text. path: a tokenizer's JSON file that every executor has.
    """
    path = path or tokenizer_path()
    space = Workspace(spark, "packing")
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenize(path, agrees(path)), "doc_id long, curve long, doc_tokens long, ids binary")
    tokens = space.write(rows, "tokens", "none")
    total = tokens.agg(F.sum("doc_tokens")).first()[0] or 0
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(usual, -(-total // LEAST_TOKENS)), -(-total // MOST_TOKENS))
    along = tokens.repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids
    return along.mapInArrow(_pack(length, with_ids), schema)
