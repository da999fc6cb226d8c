import binascii
import hashlib
import re
import time
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import langid, queries, secrets
from tests.llm.conftest import ODD

BASE = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    found = [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
    return sorted(found, key=lambda s: (s[1], list(BASE).index(s[0])))


def digest(found):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()


def test_secrets_query(spark, small, documents):
    rows = {r.doc_id: r for r in queries.op6_secrets(spark, small).collect()}
    assert len(rows) == len(documents)
    for d, t, _ in documents:
        found = brute(t)
        assert rows[d].base_sha256 == digest(found)
        assert (rows[d].n_assign, rows[d].n_access, rows[d].n_hex) == tuple(sum(k == x for k, _, _ in found) for x in BASE)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "Passwd", "SECRET", "token", "api_key", "apiKEY", "=", ": ", '"', "AKIA", "ABCDEFGH", "0123456789", "abcdef", "deadbeef", " ", "é", "İ", "K", "\n", ".", "x"]), max_size=40).map("".join))
def test_base_spans_stay(text):
    assert [s for s in secrets.spans(text) if s[0] in secrets.BASE] == brute(text)


def test_checksums():
    body = "A1b2C3d4E5f6G7h8I9j0K1l2M3n4O5"
    good = f"ghp_{body}{secrets.checksum(body)}"
    assert ("github", 2, 2 + len(good)) in secrets.spans(f"x {good} y")
    assert not secrets.spans(f"x ghp_{body}{'0' * 6} y")
    assert secrets.checksum("") == "000000" and int(binascii.crc32(body.encode())) < 62**6
    pem = "-----BEGIN RSA PRIVATE KEY-----\nMIIB\n-----END RSA PRIVATE KEY-----"
    assert secrets.spans(pem) == [("pem", 0, len(pem))]
    assert secrets.redacted(f"a {pem} b") == "a <secret> b" and secrets.redacted(None) is None


_JWT = re.compile(r"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----[A-Za-z0-9+/=\s:,-]*?-----END \1-----")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["-----BEGIN ", "-----END ", "RSA ", "PRIVATE KEY", "-----", "MIIB", "\n", "!", "eyJhIjoxfQ", "eyJ", ".", "x", " ", "e30"]), max_size=40).map("".join))
def test_added_kinds_are_those_of_their_expressions(text):
    """Leftmost non-overlapping matches of the plain expressions, tokens with JSON objects in them."""
    pem = [("pem", m.start(), m.end()) for m in _PEM.finditer(text)]
    jwt = [("jwt", m.start(), m.end()) for m in _JWT.finditer(text) if secrets._is_json(m[1]) and secrets._is_json(m[2])]
    assert [s for s in secrets.spans(text) if s[0] == "pem"] == pem and [s for s in secrets.spans(text) if s[0] == "jwt"] == jwt


@pytest.mark.parametrize("unit", ["eyJ", "eyJ.", "eyJa.b ", "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN RSA PRIVATE KEY-----\n-----END DSA PRIVATE KEY-----", "password ", "token = ", "-----BEGIN A PRIVATE KEY-----!", "AKIA", "ghp_", "eyJ" + "W" * 60 + "."])
def test_very_long_runs_take_linear_time(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    secrets.spans(text)
    assert time.perf_counter() - began < 20
    assert secrets.spans("[" * 200_000 + " eyJ" + "W1tb" * 50_000 + ".e30.") == []


def test_secrets_odd(spark, odd, nothing):
    rows = secrets.scan(odd).collect()
    assert len(rows) == len(ODD) and secrets.scan(nothing).count() == 0
    clean = secrets.redact(odd)
    assert clean.columns == odd.columns and not any(secrets.spans(r.text) for r in clean.collect())


def test_language_held_out(spark):
    rows = queries.op10_language(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and all(r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.97 and sum(r.rejected for r in rows) <= 5
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd(spark, odd, nothing, documents):
    learn = spark.createDataFrame(documents, "doc_id long, text string, lang string")
    model = langid.train(spark, learn)
    rows = {r.doc_id: r for r in langid.classify(spark, odd.withColumnRenamed("kept", "score"), model).collect()}
    assert {rows[k].lang_pred for k in (1, 2, 3, 9)} == {"und"} and rows[1].rejected and rows[9].score == 0
    assert rows[8].rejected and rows[7].lang_pred in model.languages
    assert langid.classify(spark, nothing, model).count() == 0
    bare = langid.train(spark, nothing)
    assert {r.lang_pred for r in langid.classify(spark, odd, bare).collect()} == {"und"}
    sure = langid.classify(spark, spark.createDataFrame([(1, "kjxqz wvvkq zzxqj " * 30)], "doc_id long, text string"), model).first()
    assert sure.rejected


def dictionary_kneser_ney(grams, order, size):
    """Interpolated Kneser-Ney by plain dictionaries. grams: tuples of `order` symbols, as often as they come; size: of the vocabulary."""
    counts = [defaultdict(lambda: defaultdict(int)) for _ in range(order)]
    for gram in grams:
        counts[order - 1][gram[:-1]][gram[-1]] += 1
    for n in range(order - 1, 0, -1):  # distinct left neighbours
        for context, row in counts[n].items():
            for symbol in row:
                counts[n - 1][context[1:]][symbol] += 1
    discounts = []
    for level in counts:
        values = [c for row in level.values() for c in row.values()]
        ones, twos = values.count(1), values.count(2)
        discounts.append(min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5)

    def p(context, symbol):
        n = len(context)
        row = counts[n].get(context, {})
        lower = p(context[1:], symbol) if n else 1 / size
        total = sum(row.values())
        return max(row.get(symbol, 0) - discounts[n], 0) / total + discounts[n] * len(row) / total * lower if row else lower

    return p


@pytest.mark.parametrize("order", [2, 3, 4])
def test_model_is_dictionary_kneser_ney(order):
    texts = [["the cat sat on the mat and the rat", "a cat that sat"], ["der hund und das rad", "das tat der hund dann"]]
    alphabet = np.array(sorted({ord(c) for x in texts for t in x for c in t if c != " "}))
    blank = langid.Model(["p", "q"], alphabet, [], [])

    def grams(text):
        ids = [0] * (order - 1) + blank.codes(langid.symbols(text)).tolist()
        return [tuple(ids[i : i + order]) for i in range(1, len(ids) - order + 1)]

    codes = [np.concatenate([langid._windows(blank.codes(langid.symbols(t)), order)[order - 1] for t in own]) for own in texts]
    rows = np.stack([np.concatenate(codes), np.repeat([0, 1], [len(c) for c in codes]).astype(np.uint64)])
    keys, n = np.unique(rows, axis=1, return_counts=True)
    model = langid.fit(["p", "q"], alphabet, keys[0], keys[1].astype(int), n, order)
    tried = {g for t in ["dat cxt und", *texts[0], *texts[1]] for g in grams(t)} | {(langid.OTHER,) * order, (0,) * order}
    for k, own in enumerate(texts):
        p = dictionary_kneser_ney([g for t in own for g in grams(t)], order, len(alphabet) + 2)
        for gram in tried:
            mine = np.exp(float(model.log_probabilities(np.array(gram, np.uint64), order)[-1][k]))
            assert abs(mine - p(gram[:-1], gram[-1])) < 1e-5


@pytest.mark.parametrize("order", [1, 2, 3])
def test_probabilities_sum_to_one(order):
    texts = ["abab abba", "cab bac"]
    alphabet = np.array(sorted({ord(c) for t in texts for c in t if c != " "}))
    blank = langid.Model(["p", "q"], alphabet, [], [])
    codes, lang = [], []
    for k, t in enumerate(texts):
        codes.append(langid._windows(blank.codes(langid.symbols(t)), order)[order - 1])
        lang.append(np.full(len(codes[-1]), k))
    keys, n = np.unique(np.stack([np.concatenate(codes), np.concatenate(lang).astype(np.uint64)]), axis=1, return_counts=True)
    model = langid.fit(["p", "q"], alphabet, keys[0], keys[1].astype(int), n, order)
    every = [0, 1, 2, 3, langid.OTHER]
    for context in ([0, 1], [1, 2], [3, 3], [2, 0]):
        total = sum(np.exp(model.log_probabilities(np.array([*context, w], np.uint64), order)[-1].astype(float)) for w in every)
        assert np.allclose(total, 1, atol=1e-4)
