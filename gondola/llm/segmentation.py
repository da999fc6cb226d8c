"""SentencePiece encoding and decoding, with Gumbel top-k sampling of segmentations without replacement.

A text's lattice has a state for each character and an edge for each piece of the vocabulary (bytes where a character
has no piece). Pieces never cross the start of a word, so the lattice is a chain of words, and each distinct word of
a slice of texts is built once: all substrings that begin a piece are looked up at once, and a backward pass gives every
state the log-sum of its completions, so every edge its conditional probability.

The k segmentations are those with the k largest Gumbel-perturbed log-probabilities, found by A-star search from the
top: a node is a prefix of words with segmentations excluded for the next word; its perturbed maximum is a Gumbel draw at
the node's log-mass, truncated at its parent's. The best open node is expanded to a complete segmentation by drawing edges
in proportion to their mass, and every word on the way leaves a node for its other segmentations. Segmentations come out
distinct and in order, and the value of the best node then left open gives each the probability with which a threshold of
that height includes it (its inclusion score). All texts of a slice draw together, each from a counter-based generator
that its row key seeds, so results don't depend on partitions or retries.

A BPE model's scores are ranks, so a piece weighs -log(rank + 2), over the temperature; a byte of a fallback weighs
as the last rank.

Defined cases: null and empty texts have one segmentation, of no pieces, inclusion 1; a text with fewer than k
segmentations gives all of them, inclusion 1; repeated rows give equal samples; a null key seeds like 0; U+2581 in a
text decodes to a space, as in SentencePiece itself. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import in_slices, released

MODEL = "piece_bpe_32k.model"
SAMPLES, TEMPERATURE = 3, 0.5
#: Characters whose lattice is built at once.
SLICE = 1_500_000
MARK = "▁"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    def __init__(self, path: str, temperature: float):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        m = self.model
        size = m.get_piece_size()
        pieces = [(m.id_to_piece(k), k, m.get_score(k)) for k in range(size) if not (m.is_control(k) or m.is_unknown(k) or m.is_unused(k) or m.is_byte(k))]
        self.byte = {int(m.id_to_piece(k)[3:5], 16): k for k in range(size) if m.is_byte(k)}
        self.longest = max(len(p) for p, _, _ in pieces)
        self.fallback = -math.log(len(pieces) + 2) / temperature
        self.weights = {p: (k, -math.log(2 - min(0.0, s)) / temperature) for p, k, s in pieces}
        shown = [b""] * size  # what an id decodes to
        for p, k, _ in pieces:
            shown[k] = p.replace(MARK, " ").encode()
        for byte, k in self.byte.items():
            shown[k] = bytes([byte])
        self.shown_size = np.array([len(x) for x in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_size) - self.shown_size
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self._hashed()

    def _hashed(self) -> None:
        """A hash table of all beginnings of pieces, with the piece that ends there, if any."""
        found: dict[int, tuple[int, float]] = {}
        by_size: dict[int, list[str]] = {}
        for p in self.weights:
            by_size.setdefault(len(p), []).append(p)
        for size, own in by_size.items():
            chars = np.array([[ord(c) for c in p] for p in own], np.uint64)
            h = np.zeros(len(own), np.uint64)
            for j in range(size):
                h = _hash_step(h, chars[:, j])
                if j + 1 < size:
                    for x in h.tolist():
                        found.setdefault(x, (-1, 0.0))
            for p, x in zip(own, h.tolist()):
                if found.get(x, (-1, 0.0))[0] >= 0:
                    raise ValueError("pieces share a hash")
                found[x] = self.weights[p]
        self.bits = max(4, (3 * len(found)).bit_length())
        mask = (1 << self.bits) - 1
        self.keys, self.piece, self.weight = np.zeros(mask + 1, np.uint64), np.full(mask + 1, -1, np.int32), np.zeros(mask + 1)
        taken: set[int] = set()
        for x, (piece, weight) in found.items():
            slot = x >> (64 - self.bits)
            while slot in taken:
                slot = (slot + 1) & mask
            taken.add(slot)
            self.keys[slot], self.piece[slot], self.weight[slot] = x, piece, weight

    def look(self, h: np.ndarray) -> np.ndarray:
        """Slots of these hashes, -1 where they are unknown."""
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        open_ = np.flatnonzero((key != h) & (key != 0))
        slot[(key == 0)] = -1
        while len(open_):
            at = (slot[open_] + 1) & (len(self.keys) - 1)
            key = self.keys[at]
            slot[open_] = np.where(key == 0, -1, at)
            open_ = open_[(key != h[open_]) & (key != 0)]
        return slot

    def decoded(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids stand for, one after another, and the end of each id's."""
        size = self.shown_size[ids]
        upto = np.cumsum(size)
        return self.shown[np.repeat(self.shown_start[ids] - (upto - size), size) + np.arange(int(upto[-1]) if len(upto) else 0)], upto


def _hash_step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    h = (h + c + np.uint64(1)) * _STEP
    return h ^ (h >> np.uint64(29))


@lru_cache(maxsize=2)
def vocabulary(path: str, temperature: float) -> Vocabulary:
    return Vocabulary(path, temperature)


# Random numbers by counter -------------------------------------------------------------------------------------------


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def uniform(seed: np.ndarray, counter: np.ndarray) -> np.ndarray:
    """Between 0 and 1, never one of them."""
    x = counter.astype(np.uint64)
    x *= _STEP
    x += seed
    x = _mixed(x)
    x >>= np.uint64(11)
    out = x.astype(float)
    out += 0.5
    out *= 2.0**-53
    return out


def _one_uniform(seed: int, counter: int) -> float:
    """uniform() of one number: an array of one costs as much as one of hundreds."""
    mask = (1 << 64) - 1
    x = (seed + counter * int(_STEP)) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return (((x ^ (x >> 31)) >> 11) + 0.5) * 2.0**-53


def _below(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel draws at these log-masses, truncated at the bound."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = -np.logaddexp(-bound, np.log(-np.log(u)) - mass)
    return np.where(np.isfinite(mass), out, -np.inf)


# Lattice ---------------------------------------------------------------------------------------------------------------


@dataclass
class Lattice:
    """States of all distinct words, and their edges: those of a state together, the longest first."""

    first: np.ndarray  # state of each word
    edge: np.ndarray  # first edge of each state
    count: np.ndarray  # edges of each state
    target: np.ndarray  # state that an edge leads to, the number of states at a word's end
    logp: np.ndarray  # of an edge, given its state
    rest: np.ndarray  # log-probability of all other edges of its state
    prob: np.ndarray  # of an edge, given its state
    upto: np.ndarray  # cumulated probabilities, beyond 1 at a state's last edge
    id_start: np.ndarray  # ids of an edge
    id_count: np.ndarray
    ids: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, vocab: Vocabulary) -> Lattice:
        bounds = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
        text = words.buffers()[2][int(bounds[0]) : int(bounds[-1])].to_pybytes().decode() if len(words) else ""
        chars = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        sizes = pc.utf8_length(words).to_numpy().astype(np.int64)
        first, n = np.cumsum(sizes) - sizes, len(chars)
        left = np.repeat(first + sizes, sizes) - np.arange(n)  # characters to the word's end
        h, rows, found = np.zeros(n, np.uint64), np.arange(n), []
        bare = octets = np.zeros(0, np.int64)
        for size in range(1, vocab.longest + 1):
            on = left[rows] >= size
            rows, h = rows[on], h[on]
            if not len(rows):
                break
            h = _hash_step(h, chars[rows + size - 1])
            slot = vocab.look(h)
            piece = np.where(slot >= 0, vocab.piece[slot], -1)
            own = np.flatnonzero(piece >= 0)
            found.append((rows[own], size, piece[own], vocab.weight[slot[own]]))
            if size == 1:
                bare = np.flatnonzero(piece < 0)
                octets = 1 + (chars[bare] > 0x7F).astype(np.int64) + (chars[bare] > 0x7FF) + (chars[bare] > 0xFFFF)
                found.append((bare, 1, np.full(len(bare), -1, np.int32), vocab.fallback * octets))
            rows, h = rows[slot >= 0], h[slot >= 0]
        # edges by state, states by their distance from the word's end
        count = np.zeros(n, np.int32)
        for r, *_ in found:
            count[r] += 1
        order = np.argsort(left.astype(np.uint16) if left.max(initial=0) < 1 << 16 else left, kind="stable")
        edge, total = np.zeros(n, np.int64), int(count.sum())
        edge[order] = np.cumsum(count[order]) - count[order]
        target, weight, piece = np.empty(total, np.int32), np.empty(total), np.empty(total, np.int32)
        filled = edge.copy()
        for r, size, ids, w in reversed(found):
            at = filled[r]
            target[at] = np.where(left[r] == size, n, r + size)
            weight[at], piece[at] = w, ids
            filled[r] += 1
        del filled, found
        # log-sums of all completions
        beta = np.zeros(n + 1)
        levels = np.searchsorted(left[order], np.arange(1, int(left.max(initial=0)) + 2)).tolist()
        for a, b in zip(levels[:-1], levels[1:]):
            r = order[a:b]
            size, begin = count[r], edge[r] - edge[r[0]]
            e = slice(int(edge[r[0]]), int(edge[r[0]]) + int(begin[-1]) + int(size[-1]))
            sums = weight[e] + beta[target[e]]
            top = np.maximum.reduceat(sums, begin)
            beta[r] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, size)), begin))
            weight[e] = sums - np.repeat(beta[r], size)
        # probabilities before and after each edge of its state, summed without loss
        p = np.exp(weight)
        upto, rest = np.empty(total), np.zeros(total)
        by_count = np.argsort((-count).astype(np.int16), kind="stable")  # a state has at most an edge for each size of piece
        states = np.searchsorted(-count[by_count], -np.arange(int(count.max(initial=0)) + 1), side="left").tolist()
        start = edge[by_count]
        last = start + count[by_count] - 1
        run = np.zeros(n)
        for j in range(len(states) - 1):  # states with more than j edges
            e, sums = start[: states[j]] + j, run[: states[j]]
            rest[e] = sums
            sums += p[e]
            upto[e] = sums
        run[:] = 0.0
        for j in range(len(states) - 1):
            e, sums = last[: states[j]] - j, run[: states[j]]
            rest[e] += sums
            sums += p[e]
        upto[last] = 2.0
        with np.errstate(divide="ignore"):
            np.log(rest, out=rest)
        size = np.ones(total, np.int64)
        spelled = np.flatnonzero(piece < 0)
        if len(spelled):
            state = np.searchsorted(edge[order], spelled, side="right") - 1
            state = order[state]
            size[spelled] = octets[np.searchsorted(bare, state)]
        start = np.cumsum(size) - size
        ids = np.repeat(piece, size)
        for e, c in zip(spelled.tolist(), (chars[state].tolist() if len(spelled) else ())):
            ids[start[e] : start[e] + size[e]] = [vocab.byte[b] for b in chr(c).encode()]
        return cls(first, edge, count, target, weight, rest, p, upto, start, size, ids)

    def walk(self, word: np.ndarray, seed: np.ndarray, place: np.ndarray) -> Segments:
        """Draws a segmentation of each word. seed: of each draw's text and path; place: of the word's first character there."""
        n, m = len(self.edge), len(word)
        state = self.first[word]
        ahead = place - state
        on, logp, rest, steps, length = np.arange(m), np.zeros(m), np.zeros(m), [], np.zeros(m, np.int64)
        while len(on):
            here = slice(None) if len(on) == m else on  # all at first: views, no copies
            e = self.edge[state]
            u = uniform(seed[here], 2 * (ahead[here] + state))
            more = np.flatnonzero(u >= self.upto[e])
            while len(more):
                e[more] += 1
                more = more[u[more] >= self.upto[e[more]]]
            steps.append((on, e))
            rest[here] += np.exp(logp[here] + self.rest[e])
            logp[here] += self.logp[e]
            length[here] += 1
            state = self.target[e]
            onward = state < n
            on, state = on[onward], state[onward].astype(np.int64)
        start = np.cumsum(length) - length
        edges = np.empty(int(length.sum()), np.int64)
        for j, (own, e) in enumerate(steps):
            edges[start[own] + j] = e
        with np.errstate(divide="ignore"):
            return Segments(edges, start, length, logp, np.log(rest))

    def _edges(self, state: int) -> list[float]:
        begin = int(self.edge[state])
        return self.prob[begin : begin + int(self.count[state])].tolist()

    def other(self, word: int, gone: list[tuple[int, ...]], draw: Callable[[], float]) -> tuple[tuple[int, ...], float]:
        """A segmentation of the word that is none of those excluded, drawn by probability, and the probability of the rest."""
        tree = Excluded(self, int(self.first[word]))
        tree.weigh(sorted({node for segment in gone for node in tree.add(segment)}))
        state, node, found = int(self.first[word]), 0, []
        while state < len(self.edge):
            p = tree.left[node] if node >= 0 else self._edges(state)
            u, k = draw() * sum(p), 0
            while k + 1 < len(p) and (u >= p[k] or p[k] == 0.0):
                u -= p[k]
                k += 1
            while p[k] == 0.0:  # rounding: the last edge that is left
                k -= 1
            e = int(self.edge[state]) + k
            found.append(e)
            state, node = int(self.target[e]), tree.nodes[node].get(e, -1) if node >= 0 else -1
        tree.weigh(tree.add(found))
        return tuple(found), sum(tree.left[0])


class Excluded:
    """A tree of the segmentations of a word that are excluded: at each node edge -> node (0 is the word's start, -1 its end),
    and every edge's probability without them. Nodes follow their parents."""

    def __init__(self, lattice: Lattice, start: int):
        self.lattice, self.nodes, self.states = lattice, [{}], [start]
        self.left: list[list[float]] = [[]]

    def add(self, segment: Iterable[int]) -> list[int]:
        """The nodes on its way; their probabilities are to be weighed again."""
        node, way = 0, []
        for e in segment:
            way.append(node)
            if e not in self.nodes[node]:
                to = int(self.lattice.target[e])
                ends = to == len(self.lattice.edge)
                self.nodes[node][e] = -1 if ends else len(self.nodes)
                if not ends:
                    self.nodes.append({})
                    self.states.append(to)
                    self.left.append([])
            node = self.nodes[node][e]
        return way

    def weigh(self, nodes: list[int]) -> None:
        """nodes: in ascending order."""
        for node in reversed(nodes):
            state = self.states[node]
            p, begin = self.lattice._edges(state), int(self.lattice.edge[state])
            for e, child in self.nodes[node].items():
                p[e - begin] *= sum(self.left[child]) if child > 0 else 0.0
            self.left[node] = p


@dataclass
class Segments:
    """Segmentations of words: their edges, log-probabilities, and the log-probability of the word's other ones."""

    edges: np.ndarray
    start: np.ndarray
    count: np.ndarray
    logp: np.ndarray
    rest: np.ndarray

    @classmethod
    def joined(cls, parts: list[Segments]) -> Segments:
        shift = np.cumsum([0, *[len(p.edges) for p in parts[:-1]]])
        start = np.concatenate([p.start + s for p, s in zip(parts, shift.tolist())])
        return cls(np.concatenate([p.edges for p in parts]), start, *(np.concatenate([getattr(p, x) for p in parts]) for x in ("count", "logp", "rest")))

    def of(self, k: int) -> tuple[int, ...]:
        return tuple(self.edges[self.start[k] : self.start[k] + self.count[k]].tolist())


@dataclass
class Paths:
    """The paths of one rank, over all words of a slice."""

    which: np.ndarray  # segmentation of each word
    open: np.ndarray  # perturbed maximum of its other ones, as far as they are this path's to open
    value: np.ndarray  # of each text's path
    has: np.ndarray  # which texts have one


def sample(lattice: Lattice, word: np.ndarray, place: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, k: int) -> tuple[Segments, list[Paths], np.ndarray]:
    """The k best perturbed segmentations of each chain of words, and the best value left open.

    word, place: of each occurrence; offsets: of the texts' words. A node is a word of a path: the prefix is that path's,
    the word's segmentation so far and those banned there are excluded.
    """
    none, m, bounds = -np.inf, len(word), offsets.tolist()
    texts = len(seeds)
    owner = np.repeat(np.arange(texts), np.diff(offsets))
    filled = np.flatnonzero(np.diff(offsets) > 0)

    def before(which: np.ndarray, a: int, b: int) -> np.ndarray:
        return np.concatenate([[0.0], np.cumsum(segments.logp[which[a:b]])])

    own = _mixed(seeds + np.uint64(1))
    segments = lattice.walk(word, own[owner], place)
    value = -np.log(-np.log(uniform(own, np.full(texts, 1 << 62))))
    first = Paths(np.arange(m), np.empty(m), value, np.ones(texts, bool))
    ahead = np.empty(m)
    for a, b in zip(bounds[:-1], bounds[1:]):
        ahead[a:b] = before(first.which, a, b)[:-1]
    first.open = _below(ahead + segments.rest, value[owner], uniform(own[owner], 2 * place + 1))
    paths, banned = [first], {}

    def best() -> tuple[np.ndarray, np.ndarray]:
        """Of each text the largest open value, and the path that has it."""
        top = np.full((len(paths), texts), none)
        if len(filled):
            for j, p in enumerate(paths):
                top[j, filled] = np.where(p.has[filled], np.maximum.reduceat(p.open, offsets[:-1][filled]), none)
        return top.max(axis=0), top.argmax(axis=0)

    for rank in range(1, k):
        value, parent = best()
        live = np.flatnonzero(value > none)
        if not len(live):
            break
        own = _mixed(seeds + np.uint64(rank + 1))
        new = Paths(np.zeros(m, np.int64), np.full(m, none), value, value > none)
        drawn: list[tuple[int, ...]] = []
        left, spots = [], []
        base = len(segments.start)
        for t, j, seed in zip(live.tolist(), parent[live].tolist(), own[live].tolist()):
            a, b = bounds[t], bounds[t + 1]
            old = paths[j]
            i = a + int(np.argmax(old.open[a:b]))
            old.open[i] = none
            gone = banned.get((j, i), [])
            gone = [*gone, segments.of(old.which[i])]
            chosen, rest = lattice.other(int(word[i]), gone, _drawer(seed))
            banned[rank, i] = gone
            new.which[a:i] = old.which[a:i]
            new.which[i] = base + len(drawn)
            drawn.append(chosen)
            left.append(math.log(rest) if rest > 0 else none)
            spots.append(i)
        flat = np.array([e for x in drawn for e in x], np.int64)
        size = np.array([len(x) for x in drawn], np.int64)
        start = np.cumsum(size) - size
        later = np.concatenate([np.arange(i + 1, bounds[t + 1]) for t, i in zip(live.tolist(), spots)])
        walked = lattice.walk(word[later], own[owner[later]], place[later])
        new.which[later] = base + len(drawn) + np.arange(len(later))
        segments = Segments.joined([segments, Segments(flat, start, size, np.add.reduceat(lattice.logp[flat], start), np.array(left)), walked])
        for t, i in zip(live.tolist(), spots):
            ahead[i : bounds[t + 1]] = before(new.which, bounds[t], bounds[t + 1])[i - bounds[t] : -1]
        spots = np.array(spots)
        # the draw at the branch has a counter of its own; a word's first character may be another's there
        new.open[spots] = _below(ahead[spots] + np.array(left), value[owner[spots]], uniform(own[owner[spots]], 2 * place[spots] + 1))
        new.open[later] = _below(ahead[later] + walked.rest, value[owner[later]], uniform(own[owner[later]], 2 * place[later] + 1))
        paths.append(new)
    return segments, paths, best()[0]


def _drawer(seed: int) -> Callable[[], float]:
    """Uniform numbers, one after another, for the words that are drawn alone."""
    counter = (1 << 62) + 1

    def draw() -> float:
        nonlocal counter
        counter += 1
        return _one_uniform(seed, counter)

    return draw


def split_words(text: str) -> list[str]:
    """Runs of the space mark with what follows them: no piece crosses their starts."""
    if not text:
        return []
    words, held = [], ""
    for part in text.split(" "):  # a part that isn't empty ends the run of marks before it
        held += MARK
        if part:
            words.append(held + part)
            held = ""
    if held:
        words.append(held)
    return [w for word in words for w in (_cut(word) if MARK in word.lstrip(MARK) else [word])]


def _cut(word: str) -> list[str]:
    out, start = [], 0
    for k in range(1, len(word)):
        if word[k] == MARK and word[k - 1] != MARK:
            out.append(word[start:k])
            start = k
    return [*out, word[start:]]


@dataclass
class Sampled:
    """Segmentations of a slice of texts, by rank, then text."""

    row: np.ndarray
    rank: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    logp: np.ndarray
    value: np.ndarray
    inclusion: np.ndarray


def _words(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words; of each occurrence its word and its place in the text; offsets of the texts' occurrences."""
    plain = np.array([bool(t) and MARK not in t and "  " not in t and t[0] != " " and t[-1] != " " for t in texts], bool)
    order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
    marked = pc.replace_substring(pa.array([MARK + texts[k] for k in order[: plain.sum()].tolist()], pa.large_string()), " ", " " + MARK)
    split = pc.split_pattern(marked, " ")
    rest = [split_words(texts[k]) for k in order[plain.sum() :].tolist()]
    every = pa.concat_arrays([split.flatten(), pa.array([w for x in rest for w in x], pa.large_string())])
    coded = every.dictionary_encode()
    counts = np.concatenate([np.diff(split.offsets.to_numpy()), np.array([len(x) for x in rest], np.int64)])
    word = coded.indices.to_numpy().astype(np.int64)
    size = pc.utf8_length(coded.dictionary).to_numpy().astype(np.int64)[word]
    begin = np.cumsum(counts) - counts
    # back to the order of the texts
    back = np.argsort(order, kind="stable")
    count = counts[back]
    upto = np.cumsum(count)
    at = np.repeat(begin[back] - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)
    word, size = word[at], size[at]
    ahead = np.cumsum(size) - size
    offsets = np.concatenate([[0], upto]).astype(np.int64)
    starts = np.append(ahead, size.sum())[offsets[:-1]]
    return coded.dictionary, word, ahead - np.repeat(starts, count), offsets


def sampled(keys: list[int | None], texts: list[str | None], vocab: Vocabulary, k: int) -> Sampled:
    words, word, place, offsets = _words([t or "" for t in texts])
    lattice = Lattice.of(words, vocab)
    seeds = _mixed(_mixed(np.array([(x or 0) % 2**64 for x in keys], np.uint64) + _STEP))
    segments, paths, edge = sample(lattice, word, place, offsets, seeds, k)
    rows, ranks, ids, sizes, logps, values = [], [], [], [], [], []
    for rank, p in enumerate(paths, 1):
        has = np.flatnonzero(p.has)
        which = p.which if len(has) == len(texts) else p.which[np.repeat(p.has, np.diff(offsets))]
        count = np.diff(offsets)[has]
        steps = segments.edges[_spread(segments.start[which], segments.count[which])]
        spelled = lattice.id_count[steps]
        own = lattice.ids[_spread(lattice.id_start[steps], spelled) if spelled.max(initial=1) > 1 else lattice.id_start[steps]]
        # ids of each text: sums of whole numbers over its words, then over their edges
        by_word = np.concatenate([[0], np.cumsum(segments.count[which])])
        by_text = by_word[np.concatenate([[0], np.cumsum(count)])]
        sizes.append(np.diff(np.concatenate([[0], np.cumsum(spelled)])[by_text]))
        bounds = np.concatenate([[0], np.cumsum(count)]).tolist()
        logp = segments.logp[which]
        logps.append(np.array([logp[a:b].sum() for a, b in zip(bounds[:-1], bounds[1:])]))
        rows.append(has)
        ranks.append(np.full(len(has), rank, np.int32))
        ids.append(own)
        values.append(p.value[has])
    row, logp, value = np.concatenate(rows), np.concatenate(logps), np.concatenate(values)
    with np.errstate(over="ignore", divide="ignore"):
        inclusion = np.where(edge[row] == -np.inf, 1.0, -np.expm1(-np.exp(np.minimum(700.0, logp - edge[row]))))
    return Sampled(row, np.concatenate(ranks), np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), logp, value, inclusion)


def _spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places of runs, one after another."""
    upto = np.cumsum(count)
    return np.repeat(start - (upto - count), count) + np.arange(int(upto[-1]) if len(upto) else 0)


def samples(keys: list[int | None], texts: list[str | None], vocab: Vocabulary, k: int) -> Iterator[tuple]:
    """(row, rank, ids, log-probability, perturbed value, inclusion) for each text."""
    found = sampled(keys, texts, vocab, k)
    for n in np.lexsort((found.rank, found.row)).tolist():
        a, b = found.offsets[n : n + 2].tolist()
        yield int(found.row[n]), int(found.rank[n]), found.ids[a:b], float(found.logp[n]), float(found.value[n]), float(found.inclusion[n])


def decodes(found: Sampled, texts: list[str | None], vocab: Vocabulary) -> list[bool]:
    """Whether each segmentation decodes to its text."""
    data, upto = vocab.decoded(found.ids)
    data, ends = data.tobytes(), np.concatenate([[0], upto])[found.offsets].tolist()
    truth = [(" " + t.replace(MARK, " ")).encode() if t else b"" for t in texts]
    return [data[a:b] == truth[r] for r, a, b in zip(found.row.tolist(), ends[:-1], ends[1:])]


_SCHEMA = "doc_id long, rank int, ids array<int>, log_probability double, perturbed double, inclusion double"


def checked_samples(docs: DataFrame, path: str | None = None, k: int = SAMPLES, temperature: float = TEMPERATURE) -> DataFrame:
    """As encode_samples, with digests beside the ids: n_pieces, ids_crc32 (of little-endian unsigned 32-bit ids) and
    whether they decode to the text."""
    return encode_samples(docs, path, k, temperature, digest=True)


def encode_samples(docs: DataFrame, path: str | None = None, k: int = SAMPLES, temperature: float = TEMPERATURE, digest: bool = False) -> DataFrame:
    """k distinct sampled segmentations of each text (doc_id, text), best perturbed first."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(path, temperature)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for part in in_slices(rows, lambda r: len(r[1] or "") + 1, SLICE):
                texts = [r[1] for r in part]
                found = sampled([r[0] for r in part], texts, vocab, k)
                columns = {"doc_id": pa.array([r[0] for r in part], pa.int64()).take(pa.array(found.row)), "rank": pa.array(found.rank), "ids": pa.ListArray.from_arrays(pa.array(found.offsets.astype(np.int32)), pa.array(found.ids))}
                if digest:
                    data, ends = found.ids.astype("<u4").tobytes(), (4 * found.offsets).tolist()
                    columns |= {"n_pieces": pa.array(np.diff(found.offsets)), "ids_crc32": pa.array([zlib.crc32(data[a:b]) for a, b in zip(ends[:-1], ends[1:])], pa.int64()), "decoded": pa.array(decodes(found, texts, vocab))}
                columns |= {"log_probability": pa.array(found.logp), "perturbed": pa.array(found.value), "inclusion": pa.array(found.inclusion)}
                yield pa.RecordBatch.from_pydict(columns)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(run), _SCHEMA.replace("ids array<int>", "ids array<int>, n_pieces long, ids_crc32 long, decoded boolean") if digest else _SCHEMA)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the model's own segmentation."""
    path = path or model_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path, TEMPERATURE).model
        for batch in batches:
            ids = model.encode([t or "" for t in batch.column(1).to_pylist()], num_threads=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """rows (with ids) and text instead of ids; null ids give null."""
    path = path or model_path()
    rest = [c for c in rows.columns if c.lower() not in ("ids", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = vocabulary(path, TEMPERATURE).model
        for batch in batches:
            texts = [None if x is None else model.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(texts, pa.string())], names=[*rest, "text"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in rest]
    return rows.select(*rest, "ids").mapInArrow(run, ", ".join([*fields, "text string"]))
