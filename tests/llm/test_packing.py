import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gondola.llm import packing, queries
from tests.llm.conftest import ODD


def check(rows, docs):
    """docs: (doc_id, text) with distinct ids."""
    tok = Tokenizer.from_file(packing.tokenizer_path())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and at & (at - 1) == 0


def test_query(spark, small, documents):
    check(queries.op4_packing(spark, small).collect(), [(d, t) for d, t, _ in documents])


def test_odd(spark, odd, nothing):
    rows = packing.pack(spark, odd)
    single = odd.dropDuplicates(["doc_id"]).filter("doc_id IS NOT NULL")
    check(packing.pack(spark, single, with_ids=False).collect(), [(r.doc_id, r.text) for r in single.collect()])
    assert Counter(r.doc_id for r in rows.filter("start = 0").collect()) == Counter(r[0] for r in ODD)
    first = rows.filter("doc_id = 6").first()
    assert len(first.ids) == first.length
    assert packing.pack(spark, nothing).count() == 0


def test_ids_are_the_tokenizers_own():
    """Every assigned code point between letters, digits, spaces and itself, and mixed texts with the special token."""
    path = packing.tokenizer_path()
    assert packing.agrees(path)
    own, fast = packing.encoder(path, False), packing.encoder(path, True)
    for low in [*range(0, 0x33000, 4096), 0xE0000, 0xF0000, 0x10F000]:
        text = "|".join(f"a{c}b1{c}2. {c} {c}{c}x" for c in map(chr, range(low, low + 4096)) if not "\ud800" <= c <= "\udfff")
        assert (own(text) == fast(text)).all() if text else True
    rng, parts = np.random.default_rng(3), ["a", "foo", " ", "\n", "  ", "é", "\t", "'s", "12", ".", "<|endoftext|>", "<|endof", "\u00a0", "\x1c", "\x85", "\U0001f600"]
    for _ in range(5000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 14))))
        assert own(text).tolist() == fast(text).tolist()
    assert 50256 in own("a <|endoftext|> b").tolist()


def test_special_tokens_in_texts(spark):
    rows = [(1, "hello <|endoftext|> world"), (2, "<|endoftext|>"), (3, " <|endoftext|>\n\n<|endoftext|> x" * 700)]
    check(packing.pack(spark, spark.createDataFrame(rows, "doc_id long, text string"), with_ids=False).collect(), rows)


@pytest.mark.parametrize("d,bits", [(2, 3), (3, 2), (4, 2)])
def test_hilbert_steps_to_neighbours(d, bits):
    side = 1 << bits
    cells = np.stack(np.meshgrid(*[np.arange(side)] * d, indexing="ij"), -1).reshape(-1, d)
    keys = packing.hilbert((cells + 0.5) / side * 2 - 1, bits, 1.0)
    assert sorted(keys.tolist()) == list(range(side**d))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
