import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import suffix_dedup as sd
from tests.llm.conftest import ODD


def brute(rows):
    """rows: (doc_id, bytes) -> (doc_id, bytes, removed, spans, sha256 of the rest)."""
    first = {}
    for d, t in rows:
        if d is not None:
            for i in range(len(t) - 49):
                w = t[i : i + 50]
                first[w] = min(d, first.get(w, d))
    out = []
    for d, t in rows:
        gone = bytearray(len(t))
        if d is not None:
            for i in range(len(t) - 49):
                if first[t[i : i + 50]] < d:
                    gone[i : i + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out.append((d, len(t), sum(gone), sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(spark, df):
    return sorted((tuple(r) for r in sd.dedup(spark, df).withColumn("kept", sd.digest()).collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2) | st.just(2**40 - 1), min_size=1, max_size=12), min_size=1, max_size=12))
def test_columns(strings):
    lengths = np.array([len(s) for s in strings])
    symbols = np.zeros((len(strings), lengths.max()), np.uint64)
    for k, s in enumerate(strings):
        symbols[k, : len(s)] = s
    built = sd.Columns(symbols, lengths)
    suffixes = sorted((s[i:], k, i) for k, s in enumerate(strings) for i in range(len(s) + 1))
    # equal suffixes are ordered by their ends, which sort by string
    assert built.transform().tolist() == [0 if i == 0 else strings[k][i - 1] + 1 for _, k, i in suffixes]

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    assert built.lcp.tolist() == [0] + [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 40), st.integers(1, 3))
def test_least_of_windows(seed, n, letters):
    """Strings of 50 to 76 bytes with equal windows at any offsets."""
    rng = np.random.default_rng(seed)
    source = rng.integers(97, 97 + letters, 200).astype(np.uint8)
    rows, least = np.zeros((n, sd.WIDTH + 1), np.uint8), rng.integers(0, 50, n)
    for k in range(n):
        size, at = int(rng.integers(sd.WINDOW, sd.WIDTH + 1)), int(rng.integers(0, 200 - sd.WIDTH))
        rows[k, :size], rows[k, sd.WIDTH] = source[at : at + size], size
    first = {}
    for k in range(n):
        for w in range(rows[k, sd.WIDTH] - sd.WINDOW + 1):
            window = rows[k, w : w + sd.WINDOW].tobytes()
            first[window] = min(int(least[k]), first.get(window, sd.NEVER))
    want = [[first[rows[k, w : w + sd.WINDOW].tobytes()] if w <= rows[k, sd.WIDTH] - sd.WINDOW else sd.NEVER for w in range(sd.RUN)] for k in range(n)]
    assert sd.least_of_windows(rows, least).tolist() == want


def test_the_order_finds_what_repeats(monkeypatch):
    """With every window told apart from all others, nothing repeats between chunks."""
    texts = ["a passage that three documents share, word for word, of more than fifty bytes " * 2] * 3
    chunks = [sd.Chunk([k], np.array([0, len(t)]), np.frombuffer(t.encode(), np.uint8)) for k, t in enumerate(texts)]
    anchors = [np.unique(c.runs()[2]) << np.uint64(1) for c in chunks]

    def removed():
        rows = [(k, s.spot[0], s) for k, c in enumerate(chunks) for s in [sd.Strings.of(c, anchors[k], 0)]]
        import pyarrow as pa

        table = pa.table({"range": pa.array([0] * 3, pa.int32()), "chunk": pa.array([0, 1, 2]), "data": pa.array([sd._packed(s.least, s.rows) for _, _, s in rows], pa.binary())})
        answers = sd._resolve(table).to_pylist()
        return [int(sd._covered(c, anchors[k], {a["range"]: a["data"] for a in answers if a["chunk"] == k}, 0).sum()) for k, c in enumerate(chunks)]

    found = removed()
    assert found[1:] == [len(texts[0])] * 2 and found[0] < len(texts[0])
    monkeypatch.setattr(sd, "least_of_windows", lambda rows, least: np.where(np.arange(sd.RUN)[None, :] <= rows[:, sd.WIDTH:].astype(int) - sd.WINDOW, least[:, None], sd.NEVER))
    assert removed() == [found[0]] * 3


def test_small_table(spark, small, documents):
    truth = brute([(d, (t or "").encode()) for d, t, _ in documents])
    assert run(spark, spark.read.parquet(f"{small}/documents.parquet")) == truth and any(r[2] for r in truth)


@pytest.mark.parametrize("hot", [64, 0])
def test_odd(spark, odd, nothing, monkeypatch, hot):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(300)]
    passage = " ".join(words[:25])
    extra = [(100 + k, " ".join(rng.choice(words, 40)) + passage[k % 7 :] + " ".join(rng.choice(words, 30)), None, 0) for k in range(60)]
    extra += [(300, "a" * 49, None, 0), (301, "a" * 49, None, 0), (302, "é" * 25, None, 0), (303, "xé" + "é" * 24, None, 0), (None, extra[0][1], None, 0), (100, extra[0][1], None, 0), (99, extra[5][1], None, 0)]
    monkeypatch.setattr(sd, "HOT_CHUNKS", hot)
    rows = [*ODD, *extra]
    df = spark.createDataFrame(rows, odd.schema).repartition(5)
    assert run(spark, df) == brute([(r[0], (r[1] or "").encode()) for r in rows])
    assert run(spark, nothing) == []


def test_long_text_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(2)
    text = "".join(rng.choice(list("abcdefghij "), 5000))
    monkeypatch.setattr(sd, "SLICE", 300)
    chunk = sd.Chunk([1, 2], np.array([0, 5000, 7000]), np.frombuffer((text + text[1000:3000]).encode(), np.uint8))
    left, right, anchor, doc = chunk.runs()
    assert (right - left + 1).sum() == 5000 - 49 + 2000 - 49 and set(doc.tolist()) == {1, 2}
    marked = np.unique(anchor) << np.uint64(1)
    gone = sd._covered(chunk, marked, {}, 4)
    assert not gone[:5000].any() and gone[5000:].mean() > 0.5
