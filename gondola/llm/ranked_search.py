"""Ranked lexical search by variable-block-max WAND over shards.

`build` cuts the documents of each task into shards of bounded size and writes an inverted index: for each (shard, term)
the documents that hold it with their impacts, in blocks of varying length. Dynamic programming chooses the boundaries:
over all cuts of a posting list into blocks of at most BLOCK postings it minimises the sum of the bound errors (block
maximum less impact, over all postings) plus BLOCK_COST for each block. All lists of a slice are cut at once: a step takes
the next posting of every list that still has one.

`search` sends each query block's terms (bounded in bytes) to the index, gathers a shard's matching lists in one task and
skips: the maxima of the blocks that cover a document bound its score; documents are taken in descending order of their
bounds, only blocks that cover one of them are decoded, and the shard is done once the next bound is below the k-th score
found. Bounds equal to it are still looked at, so ties are exact. The shards' best k meet in a window whose
limit Spark applies before the shuffle.

Terms are runs of code points other than ASCII ones that are neither letter nor digit, A-Z lower-cased. N documents have
a term, L terms in all. An impact is (10^9 tf) div (1000 tf + 8 m), m = 10 + (90 n N) div L; a term's weight is
floor(1000 ln((2 N + 2) / (2 df + 1))); a score sums weight x impact over the item's distinct terms.

Defined cases: null and empty texts, and texts without a term, hold nothing and are found by nothing, nor do items without
terms find anything. Rows of one item_id (null is one, too) are one item, of all their terms. Each document row is a
document of its own, repeated rows and ids too; equal scores go by ascending doc_id, null last. Very long texts are
whole (a shard may be one document). An empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, released, trimmed

K = 10
#: Most postings of a block, and what a block costs beside its bound errors (in units of impacts, whose most is 10^6).
BLOCK, BLOCK_COST = 32, 500_000
#: A shard is full at so many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1 << 20, 1 << 15
#: Lists whose boundaries are chosen at once.
LISTS = 8192
#: Bytes of terms of the items that are searched for together.
QUERY_BYTES = 8 << 20
#: Documents scored before the first look at the threshold.
FIRST = 64
#: Letters lower-cased, digits and bytes of non-ASCII code points kept, all others blanks.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("df", pa.int32()), ("docs", pa.binary()), ("impacts", pa.binary()), ("ends", pa.binary()), ("maxima", pa.binary()), ("ids", pa.list_(pa.int64()))])
_INDEX_SQL = "shard long, term binary, df int, docs binary, impacts binary, ends binary, maxima binary, ids array<long>"
#: The "term" of the row that carries a shard's doc_ids.
HEAD = b""


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM_BYTES).split()


def boundaries(impacts: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int = BLOCK, cost: float = BLOCK_COST) -> np.ndarray:
    """Flags over the postings: whether a block ends there. Lists lie in impacts from starts on."""
    flags = np.zeros(len(impacts), bool)
    flags[starts + lengths - 1] = True
    taken = np.ones(len(impacts), np.int32)  # length of the best last block of the prefix that ends at a posting
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 1]
    sizes = np.arange(1, most + 1, dtype=np.float64)
    for a in range(0, len(order), LISTS):
        own = order[a : a + LISTS]
        first, length = starts[own], lengths[own]
        top, total, before = np.zeros((len(own), most)), np.zeros((len(own), most)), np.full((len(own), most), np.inf)
        before[:, 0] = 0
        for k in range(int(length[0])):
            n = int(np.searchsorted(-length, -k, side="left"))  # lists longer than k
            x = impacts[first[:n] + k].astype(np.float64)[:, None]
            if k:
                for table in (top, total):
                    table[:n, 1:] = table[:n, :-1]
                    table[:n, 0] = 0
            np.maximum(top[:n], x, out=top[:n])
            total[:n] += x
            price = top[:n] * sizes
            price -= total[:n]
            price += before[:n]
            best = price.argmin(axis=1)
            taken[first[:n] + k] = best + 1
            least = price[np.arange(n), best] + cost
            before[:n, 1:] = before[:n, :-1]
            before[:n, 0] = least
        at = first + length - taken[first + length - 1] - 1  # the posting before each list's last block
        while len(at):
            inside = at >= first
            at, first = at[inside], first[inside]
            flags[at] = True
            at = at - taken[at]
    return flags


class _Shard:
    """Postings of the documents so far."""

    def __init__(self) -> None:
        self.vocabulary: defaultdict[bytes, int] = defaultdict(count().__next__)
        self.ids: list[int | None] = []
        self.norms: list[int] = []
        self.numbers: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id: int | None, found: list[bytes], norm: int) -> None:
        own = Counter(found)
        self.ids.append(doc_id)
        self.norms.append(norm)
        self.numbers.append(np.fromiter(map(self.vocabulary.__getitem__, own), np.int32, len(own)))
        self.counts.append(np.fromiter(own.values(), np.int64, len(own)))
        self.size += len(own)

    def rows(self, shard: int) -> Iterator[pa.RecordBatch]:
        held = [len(x) for x in self.numbers]
        number, tf = np.concatenate(self.numbers), np.concatenate(self.counts)
        doc = np.repeat(np.arange(len(held)), held)
        impact = 1_000_000_000 * tf // (1000 * tf + 8 * np.array(self.norms, np.int64)[doc])
        order = np.argsort(number, kind="stable")
        doc, impact = doc[order].astype("<u2"), impact[order].astype("<u4")
        lengths = np.bincount(number, minlength=len(self.vocabulary))
        starts = np.cumsum(lengths) - lengths
        ends = np.flatnonzero(boundaries(impact, starts, lengths)) + 1
        maxima = np.maximum.reduceat(impact, np.r_[0, ends[:-1]])
        blocks = np.searchsorted(ends, starts + lengths, side="right") - np.searchsorted(ends, starts, side="right")
        within = (ends - np.repeat(starts, blocks)).astype("<u2")
        table = pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(lengths), shard)), pa.array(list(self.vocabulary), pa.binary()), pa.array(lengths, pa.int32()), _pieces(doc, lengths), _pieces(impact, lengths), _pieces(within, blocks), _pieces(maxima, blocks), pa.nulls(len(lengths), pa.list_(pa.int64()))],
            schema=_INDEX,
        )
        yield pa.RecordBatch.from_pylist([{"shard": shard, "term": HEAD, "df": 0, "docs": b"", "impacts": b"", "ends": b"", "maxima": b"", "ids": self.ids}], schema=_INDEX)
        for a in range(0, table.num_rows, 20_000):
            yield table.slice(a, 20_000)


def _pieces(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Runs of values as byte strings."""
    offsets = np.r_[0, np.cumsum(lengths * values.itemsize)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = [len(terms(x or b"")) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([sum(n > 0 for n in sizes)], pa.int64()), pa.array([sum(sizes)], pa.int64())], names=["documents", "terms"])


def _shards(documents: int, total: int, postings: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if found := terms(text.as_py() or b""):
                    shard.add(doc_id, found, 10 + 90 * len(found) * documents // total)
                if shard.size >= postings or len(shard.ids) >= most:
                    yield from shard.rows(number)
                    number, shard = number + 1, _Shard()
        if shard.ids:
            yield from shard.rows(number)

    return run


def build(spark: SparkSession, docs: DataFrame, postings: int = SHARD_POSTINGS, most: int = SHARD_DOCS) -> tuple[DataFrame, int]:
    """The index of docs (doc_id, text), written, and how many documents hold a term.

    Rows: shard, term, df (documents of the shard that hold it), docs (places in the shard, 16 bits each), impacts (32 bits), ends and
    maxima of the blocks, and ids: the shard's doc_ids, on one row whose term is empty."""
    if most > SHARD_DOCS:
        raise ValueError("places in a shard have 16 bits")
    whole = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    size = whole.select("text").mapInArrow(released(_sizes), "documents long, terms long").agg(F.sum("documents"), F.sum("terms")).first()
    documents, total = (size[0] or 0), (size[1] or 0)
    index = whole.mapInArrow(released(_shards(documents, max(total, 1), postings, most)), _INDEX_SQL)
    return Workspace(spark, "postings").write(index, "index"), documents


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            own = sorted(set(terms(text.as_py() or b"")))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])


class Lists:
    """A shard's posting lists, one after the other, with their blocks."""

    def __init__(self, rows: pa.Table, place: dict[bytes, int]):
        head, lists = [], []
        for k, term in enumerate(rows["term"].to_pylist()):
            (lists if term else head).append((k, term))
        self.ids = rows["ids"][head[0][0]].as_py()
        self.at = {place[term]: k for k, (_, term) in enumerate(lists)}
        at = [k for k, _ in lists]
        read = lambda name, kind: [np.frombuffer(rows[name][k].as_py(), kind) for k in at]
        docs, ends = read("docs", "<u2"), read("ends", "<u2")
        base = np.cumsum([0, *map(len, docs)])
        self.docs, self.impacts = (np.concatenate(x).astype(np.int64) for x in ([*docs, []], [*read("impacts", "<u4"), []]))
        self.maxima = np.concatenate([*read("maxima", "<u4"), []]).astype(np.int64)
        self.to = np.concatenate([*(e.astype(np.int64) + b for e, b in zip(ends, base)), np.zeros(0, np.int64)])
        self.since = np.r_[0, self.to[:-1]][: len(self.to)]
        self.first, self.last = self.docs[self.since], self.docs[self.to - 1]
        cut = np.cumsum([0, *map(len, ends)])
        self.blocks = [np.arange(a, b) for a, b in zip(cut, cut[1:])]


def best(lists: Lists, own: list[tuple[int, int]], k: int) -> tuple[list[tuple[int, int]], int, int]:
    """(place, score) of the best k documents, and how many of how many blocks were decoded. own: (list, weight)."""
    if not own:
        return [], 0, 0
    blocks = np.concatenate([lists.blocks[r] for r, _ in own])
    weight = np.repeat(np.array([w for _, w in own], np.int64), [len(lists.blocks[r]) for r, _ in own])
    first, last = lists.first[blocks], lists.last[blocks]
    n = len(lists.ids)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, weight * lists.maxima[blocks])
    np.subtract.at(change, last + 1, weight * lists.maxima[blocks])
    bound = np.cumsum(change)[:n]
    order = np.argsort(-bound, kind="stable")
    order = order[: int(np.searchsorted(-bound[order], 0, side="left"))]  # without bounds of 0
    rank = lambda d: (-int(score[d]), lists.ids[d] is None, lists.ids[d] or 0)
    score, decoded, top, done, step = np.zeros(n, np.int64), np.zeros(len(blocks), bool), [], 0, FIRST
    while done < len(order):
        least = int(score[top[k - 1]]) if len(top) >= k else 1
        some = order[done : done + step]
        some = some[bound[some] >= least]
        if not len(some):
            break
        asked = np.zeros(n, bool)
        asked[some] = True
        seen = np.r_[0, np.cumsum(asked)]
        hit = seen[last + 1] > seen[first]
        decoded |= hit
        since, to = lists.since[blocks[hit]], lists.to[blocks[hit]]
        size = to - since
        spots = np.arange(size.sum()) + np.repeat(since - (np.cumsum(size) - size), size)
        doc, gain = lists.docs[spots], lists.impacts[spots] * np.repeat(weight[hit], size)
        mine = asked[doc]
        np.add.at(score, doc[mine], gain[mine])
        done, step = done + step, step * 4
        enough = some[score[some] >= max(least, 1)].tolist()
        if len(enough) > 8 * k:  # all that reach the k-th score, ties too
            cut = -np.partition(-score[enough], k - 1)[k - 1]
            enough = [d for d in enough if score[d] >= cut]
        top = sorted([*top, *enough], key=rank)[:k]
    return [(d, int(score[d])) for d in top], int(decoded.sum()), len(blocks)


def _search(items: list[tuple[int | None, list[tuple[int, int]]]], place: dict[bytes, int], k: int):
    def run(rows: pa.Table) -> pa.Table:
        lists, out = Lists(rows, place), []
        for item, own in items:
            found, _, _ = best(lists, [(lists.at[t], w) for t, w in own if t in lists.at], k)
            out += [(item, lists.ids[d], score) for d, score in found]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("item_id", "doc_id", "score"), columns)})

    return run


def search(spark: SparkSession, index: DataFrame, documents: int, items: DataFrame, k: int = K, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best k documents. items: item_id, text; index, documents: of build()."""
    space = Workspace(spark, "ranked")
    asked = items.select(F.col("item_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(released(_item_terms), "item_id long, term binary").distinct()
    asked = space.write(asked, "asked")
    held = index.filter(F.col("term") != F.lit(HEAD)).select("term", "df").join(asked.select("term").distinct(), "term", "left_semi")
    known = space.write(asked.join(held.groupBy("term").agg(F.sum("df").alias("df")), "term"), "known")
    size = known.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    parts, found = max(1, -(-size // query_bytes)), None
    for part in range(parts):  # the stated queries, in blocks of bounded size
        rows = known.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        place, weights, by_item = {}, [], defaultdict(list)
        for r in rows:
            term = bytes(r.term)
            if term not in place:
                place[term] = len(place)
                weights.append(math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1))))
            if weights[place[term]]:
                by_item[r.item_id].append((place[term], weights[place[term]]))
        wanted = spark.createDataFrame([(t,) for t in [HEAD, *place]], "term binary")
        own = index.join(F.broadcast(wanted), "term", "left_semi")
        part_found = own.groupBy("shard").applyInArrow(trimmed(_search(list(by_item.items()), place, k)), "item_id long, doc_id long, score long")
        found = part_found if found is None else found.unionByName(part_found)
    order = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.select("item_id", "doc_id", "score", F.row_number().over(order).alias("rank")).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
