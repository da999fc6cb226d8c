"""Language identification by interpolated Kneser-Ney character models.

Characters are lower-cased letters (and marks); every run of anything else is one space. Every character seen in training is a symbol of
its own, all unseen ones are one symbol (so would be the rarest of more than SYMBOLS = 65 534 seen ones). A model of order ORDER is
trained for each language. The n-grams of all languages lie in one sorted array of hashes for each order, with the
interpolated log-probability of each language beside them, and contexts likewise with their back-off weights, so one
search serves all languages: hashes are a bijection of the exact n-gram code, spread evenly, and a directory of their
leading bits leaves about one key to compare. A text gets the language of lowest cross-entropy per character.

Training reads about TRAIN_DOCS documents of each language (a documented bound: by the hash of doc_id, over the whole
table; four fifths are counted, one fifth calibrates). Counts of the highest order are summed over partitions; lower
orders follow from them, as Kneser-Ney counts distinct left neighbours. The sample bounds what reaches the driver.

Calibration: the temperature that turns cross-entropies into probabilities is the most likely one on held-back
documents; a text is rejected if its best cross-entropy exceeds that language's mean by REJECT deviations, where the
variance has a part that falls with the text's length, or if it has no letter.

Defined cases: null or letterless texts are `und`, score 0, rejected. With no training rows every text is `und`.
Ties go to the first language by name. Extra columns are left alone; `lang`, `source` and ids are never inputs.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import bounded, in_slices, released

ORDER = 4
#: Documents of each language that training reads, about.
TRAIN_DOCS = 1500
#: Distinct symbols told apart, less the space: what ORDER symbols of BITS bits in a 64-bit code leave room for.
SYMBOLS = 65534
BITS = 16
REJECT = 8.0
#: Characters scored at once.
SLICE = 400_000
OTHER = (1 << BITS) - 1


@lru_cache(maxsize=1)
def _fold() -> np.ndarray:
    """Code point -> lower-cased letter or mark, or 0."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha() or unicodedata.category(c)[0] == "M":
            low = c.lower()
            out[cp] = ord(low) if len(low) == 1 else cp
    return out


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> whether it is a letter."""
    return np.fromiter((chr(cp).isalpha() for cp in range(0x110000)), bool, 0x110000)


def symbols(text: str) -> np.ndarray:
    """Folded characters with single spaces (0) between runs, one at the start."""
    x = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    x = np.concatenate([np.zeros(1, np.uint32), x])
    keep = x != 0
    keep[1:] |= x[:-1] != 0
    keep[0] = True
    return x[keep]


def _mix(codes: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads codes evenly."""
    h = codes * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


@dataclass
class HashArray:
    """Sorted hashes with a row of values each."""

    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: int

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> HashArray:
        keys = _mix(codes)
        order = np.argsort(keys)
        keys, bits = keys[order], max(1, int(len(keys)).bit_length())
        first = np.searchsorted(keys >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return cls(keys, np.ascontiguousarray(values[order], np.float32), first, 64 - bits)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Row of each code, or -1."""
        h = _mix(codes)
        slot = (h >> np.uint64(self.shift)).astype(np.int64)
        at, end = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        if not len(self.keys):
            return out
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == h
        out[hit] = at[hit]
        open_ = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(open_):
            p = at[open_] + step
            same = self.keys[p] == h[open_]
            out[open_[same]] = p[same]
            open_ = open_[~same & (p + 1 < end[open_])]
            step += 1
        return out


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # code points, ascending; symbol k + 1 is alphabet[k]
    grams: list[HashArray]  # by order, from 1
    contexts: list[HashArray]  # by length, from 1; values are log back-off weights
    temperature: float = 1.0
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # (variance, variance times length)

    def codes(self, text_symbols: np.ndarray) -> np.ndarray:
        table = self.__dict__.get("_table")
        if table is None:
            table = np.full(0x110000, OTHER, np.uint64)
            table[0] = 0
            table[self.alphabet] = np.arange(1, len(self.alphabet) + 1, dtype=np.uint64)
            self.__dict__["_table"] = table
        return table[text_symbols]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def log_probabilities(self, ids: np.ndarray, order: int) -> np.ndarray:
        """Of each symbol after the first, given the ones before, in each language. ids starts with a space."""
        windows = _windows(ids, order)
        out = np.zeros((len(windows[0]), len(self.languages)), np.float32)
        left = np.arange(len(out))
        for n in range(order, 0, -1):
            rows = self.grams[n - 1].find(windows[n - 1][left])
            found = rows >= 0
            if n == order and found.all():
                return self.grams[n - 1].values[rows]
            out[left[found]] += self.grams[n - 1].values[rows[found]]
            left = left[~found]
            if not len(left):
                break
            if n > 1:  # back off: the weight of the context that is left behind
                rows = self.contexts[n - 2].find(windows[n - 1][left] >> np.uint64(BITS))
                seen = rows >= 0
                out[left[seen]] += self.contexts[n - 2].values[rows[seen]]
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(characters, nats per character in each language) of each text; characters 0 if there is no letter."""
        order = len(self.grams)
        found = [symbols(t) if t else np.zeros(1, np.uint32) for t in texts]
        n = np.array([len(s) - 1 if _letters()[s].any() else 0 for s in found], np.int64)
        total = np.zeros((len(texts), len(self.languages)))
        for run in in_slices([k for k in range(len(texts)) if n[k]], lambda k: int(n[k]), SLICE):
            if len(run) == 1:
                ids, step = self.codes(found[run[0]]), SLICE
                for a in range(1, len(ids), step):  # with the symbols before a as context
                    b = max(0, a - order)
                    total[run[0]] += self.log_probabilities(ids[b : a + step], order)[a - b - 1 :].sum(axis=0, dtype=np.float64)
                continue
            pad = np.zeros(order - 1, np.uint32)
            parts, starts, at = [], [], 0
            for k in run:
                parts += [pad, found[k]]
                starts.append(at + len(pad))
                at += len(pad) + len(found[k])
            logs = self.log_probabilities(self.codes(np.concatenate(parts)), order)
            sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])
            for k, s in zip(run, starts):
                total[k] = sums[s + n[k]] - sums[s]
        with np.errstate(invalid="ignore", divide="ignore"):
            return n, np.where(n[:, None] > 0, -total / np.maximum(n, 1)[:, None], np.inf)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """language, score, rejected, cross-entropy (infinite without letters)."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.full(len(texts), np.inf)
        n, h = self.cross_entropies(texts)
        best = h.argmin(axis=1)
        low = h[np.arange(len(h)), best]
        some = n > 0
        z = np.where(some[:, None], -self.temperature * (np.where(some[:, None], h, 0) - np.where(some, low, 0)[:, None]), 0)
        score = np.where(some, 1 / np.exp(z).sum(axis=1), 0.0)
        far = np.zeros(len(texts), bool)
        if self.mean is not None:
            deviation = np.sqrt(self.spread[best, 0] + self.spread[best, 1] / np.maximum(n, 1))
            far = low > self.mean[best] + REJECT * deviation
        return [self.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())], score, ~some | far, low


def _windows(ids: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1..order the code of the n symbols that end at each place from 1 on (missing ones are spaces)."""
    padded = np.concatenate([np.zeros(order - 1, np.uint64), ids])
    m = len(ids) - 1
    codes, out = np.zeros(m, np.uint64), []
    for n in range(1, order + 1):
        codes = codes | (padded[order - n + 1 : order - n + 1 + m] << np.uint64(BITS * (n - 1)))
        out.append(codes)
    return out


def fit(languages: list[str], alphabet: np.ndarray, codes: np.ndarray, lang: np.ndarray, counts: np.ndarray, order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from the counts of the highest order, row by row (code, language, count)."""
    size, mask = len(languages), np.uint64((1 << BITS) - 1)
    tables: list[tuple[np.ndarray, np.ndarray]] = []  # by order, highest first: distinct codes, counts by language
    for n in range(order, 0, -1):
        keys, back = np.unique(codes, return_inverse=True)
        table = np.zeros((len(keys), size))
        np.add.at(table, (back, lang), counts)
        tables.append((keys, table))
        if n > 1:  # the next order counts distinct left neighbours
            low = np.uint64((1 << (BITS * (n - 1))) - 1)
            rows, columns = np.nonzero(table)
            codes, lang, counts = keys[rows] & low, columns, np.ones(len(rows))
    tables.reverse()
    every = np.arange(1 << BITS, dtype=np.uint64) if len(alphabet) >= SYMBOLS else np.r_[np.arange(len(alphabet) + 1), OTHER].astype(np.uint64)
    vocabulary = len(every)
    grams: list[HashArray] = []
    contexts: list[HashArray] = []
    lower_keys, lower = None, None  # sorted codes and probabilities of the order below
    for n, (keys, table) in enumerate(tables, 1):
        ones, twos = (table == 1).sum(axis=0), (table == 2).sum(axis=0)
        discount = np.where(ones > 0, ones / np.maximum(ones + 2 * twos, 1), 0.5).clip(0.1, 0.95)
        if n == 1:
            full = np.zeros((vocabulary, size))
            full[np.searchsorted(every, keys)] = table
            total, kinds = full.sum(axis=0), (full > 0).sum(axis=0)
            p = (np.maximum(full - discount, 0) + discount * kinds / vocabulary) / np.maximum(total, 1)
            p = np.where(total > 0, p, 1 / vocabulary)
            lower_keys, lower = every, p
        else:
            above, at = np.unique(keys >> np.uint64(BITS), return_inverse=True)
            total, kinds = np.zeros((len(above), size)), np.zeros((len(above), size))
            np.add.at(total, at, table)
            np.add.at(kinds, at, table > 0)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            suffix = keys & np.uint64((1 << (BITS * (n - 1))) - 1)
            p = np.maximum(table - discount, 0) / np.maximum(total[at], 1) + weight[at] * lower[np.searchsorted(lower_keys, suffix)]
            contexts.append(HashArray.of(above, np.log(weight)))
            lower_keys, lower = keys, p
        grams.append(HashArray.of(lower_keys, np.log(lower)))
    return Model(languages, alphabet, grams, contexts)


def _count_symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(0x110000, np.int64)
    for batch in batches:
        for text in batch.column("text").to_pylist():
            counts += np.bincount(symbols(text or ""), minlength=0x110000)
    seen = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[seen], pa.int64())], names=["symbol", "n"])


def _count_grams(blank: Model, order: int):
    where = {k: i for i, k in enumerate(blank.languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                parts.setdefault(where[lang], []).append(_windows(blank.codes(symbols(text or "")), order)[order - 1])
            for k, codes in parts.items():
                keys, n = np.unique(np.concatenate(codes), return_counts=True)
                if k in held:
                    both = np.concatenate([held[k][0], keys])
                    keys, back = np.unique(both, return_inverse=True)
                    n = np.bincount(back, np.concatenate([held[k][1], n])).astype(np.int64)
                held[k] = (keys, n)
        for k, (keys, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    return count


def _apply(shared, with_lang: bool):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column("text").to_pylist()
                if with_lang:
                    n, h = model.cross_entropies(texts)
                    yield pa.RecordBatch.from_arrays([part.column("lang"), pa.array(n), pa.array([x.tolist() for x in h], pa.list_(pa.float64()))], names=["lang", "n", "h"])
                else:
                    lang, score_, rejected, h = model.predict(texts)
                    yield pa.RecordBatch.from_arrays([*part.select([c for c in part.schema.names]).columns, pa.array(lang, pa.string()), pa.array(score_, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(h, pa.float64())], names=[*part.schema.names, "lang_pred", "score", "rejected", "cross_entropy"])

    return score


def train(spark: SparkSession, rows: DataFrame, docs_per_language: int = TRAIN_DOCS, order: int = ORDER) -> Model:
    """rows: doc_id, text, lang: the only rows learned from."""
    bounded(spark)
    rows = rows.select("doc_id", "text", "lang").filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    empty = Model(languages, np.zeros(0, np.int64), [], [])
    if not languages:
        return empty
    share = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, docs_per_language / sizes[k]))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / F.lit(1_000_000)
    sample = rows.filter(place < share[F.col("lang")]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(5)))
    counted = sample.filter("fold <> 0").select("lang", "text")
    top = counted.select("text").mapInArrow(released(_count_symbols), "symbol int, n long").filter("symbol > 0").groupBy("symbol").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "symbol").limit(SYMBOLS).collect()
    blank = Model(languages, np.array(sorted(r["symbol"] for r in top), np.int64), [], [])
    grams = counted.mapInArrow(released(_count_grams(blank, order)), "lang int, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    model = fit(languages, blank.alphabet, grams["code"].to_numpy().view(np.uint64), grams["lang"].to_numpy(), grams["n"].to_numpy(), order)
    shared = spark.sparkContext.broadcast(model)
    held = sample.filter("fold = 0").select("lang", "text").mapInArrow(released(_apply(shared, True)), "lang string, n long, h array<double>").filter("n > 0").collect()
    return calibrate(model, [r["lang"] for r in held], np.array([r["n"] for r in held]), np.array([r["h"] for r in held]))


def calibrate(model: Model, lang: list[str], n: np.ndarray, h: np.ndarray) -> Model:
    if not len(lang):
        return model
    truth = np.array([model.languages.index(x) for x in lang])
    gap = h - h.min(axis=1, keepdims=True)
    fits = {t: float((-t * gap[np.arange(len(h)), truth] - np.log(np.exp(-t * gap).sum(axis=1))).mean()) for t in np.geomspace(1, 200, 40).tolist()}
    model.temperature = max(fits, key=fits.get)
    own = h[np.arange(len(h)), truth]
    model.mean, model.spread = np.zeros(len(model.languages)), np.zeros((len(model.languages), 2))
    for k in range(len(model.languages)):
        mine = truth == k
        x, size = (own[mine], n[mine]) if mine.sum() >= 20 else (own, n)
        model.mean[k] = np.median(x)
        square = (x - model.mean[k]) ** 2
        long = size >= np.median(size)
        model.spread[k] = square[long].mean() + 1e-3, max(1.0, (square * size)[~long].mean() if (~long).any() else 1.0)
    return model


def classify(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """docs (with text) and lang_pred, score, rejected, cross_entropy, which replace input columns of those names."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ("lang_pred", "score", "rejected", "cross_entropy")))
    shared = spark.sparkContext.broadcast(model)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(released(_apply(shared, False)), f"{fields}, lang_pred string, score double, rejected boolean, cross_entropy double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text the model does not reject, with all their columns as they are."""
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.filter(pa.array(~np.asarray(shared.value.predict(part.column("text").to_pylist())[2], bool)))

    return docs.mapInArrow(released(apply), docs.schema)
