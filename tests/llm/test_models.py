import binascii

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import html_extract, quality, queries, topk
from tests.llm.conftest import ODD

TEN = "/root/testdata/sf0.1"


def area(score, label):
    """Probability that a label 1 row scores above a label 0 row."""
    one, zero = score[label == 1], score[label == 0]
    return ((one[:, None] > zero).mean() + 0.5 * (one[:, None] == zero).mean()).item()


def test_quality_held_out(spark):
    rows = queries.op7_quality(spark, TEN).join(spark.read.parquet(f"{TEN}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").toPandas()
    assert (rows.held_out == rows.doc_id.map(lambda d: binascii.crc32(str(d).encode()) % 3 == 1)).all()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    held = rows[rows.held_out & rows.quality.notna()]
    assert area(held.score.to_numpy(), held.quality.to_numpy()) > 0.97 and (held.predicted == held.quality).mean() > 0.95


def test_quality_odd(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 0), (4, 1), (5, 1), (7, 1), (8, None), (99, 1)], "doc_id long, quality int")
    rows = quality.classify(spark, odd, labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in quality.classify(spark, odd, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(spark, nothing, labels).count() == 0


@settings(deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(1, 5)), min_size=1, max_size=30))
def test_isotonic(points):
    y, w = np.array([p[0] for p in points], float), np.array([p[1] for p in points], float)
    knots, values = quality.pooled(np.arange(len(y)), y, w)
    fit = np.interp(np.arange(len(y)), knots, values)
    assert (np.diff(fit) >= -1e-12).all() and abs((fit * w).sum() - (y * w).sum()) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><a href="/">Home of all</a></header>
<nav><ul><li><a href="/a">First</a><li><a href="/b">Second</a></ul></nav><div id="cookie-notice">We use cookies on this site</div>
<script>var x = "<p>no words</p>";</script>
%s
<aside>More to read here</aside><section class="comments"><h2>Comments</h2><p>I like this very much indeed, it is long.</p></section>
<form><label>Your mail</label><input></form><footer>&copy; All rights</footer></body></html>"""
BODY = "<h1>Big &amp; bold</h1><p>One   two\nthree <b>four</b> <a href='/x>y'>five</a>.</p><div class='ad'>Buy now</div><p>a &lt; b and c&nbsp;d<br>next</p><ul><li>point one</li><li>point two</li></ul>"
TEXT = "Big & bold\nOne two three four five.\na < b and c d next\npoint one\npoint two"


@pytest.mark.parametrize("frame", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>", "%s", "<article><header>%s</header>"])
def test_main_text(spark, frame):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    weights = html_extract.train(spark, pages)
    assert html_extract.extract(PAGE % (frame % BODY), weights) == TEXT


def test_pages_query(spark):
    rows = {r.page_id: r for r in queries.op5_html(spark, "/root/testdata/sf0.001").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    assert len(rows) == len(pages) and all(r.n_chars == len(r.text) for r in rows.values())
    assert sum(r.n_chars > 100 for r in rows.values()) > 0.9 * len(rows)


def test_pages_odd(spark):
    weights = html_extract.train(spark, spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    rows = [(1, "u", None, "t"), (2, "u", "", "t"), (3, None, "<<<>>> < b", "t"), (None, "u", "plain words only", "t"), (5, "u", "<p>" + "long text " * 50_000, "t"), (5, "u", "<script>never", "t"), (6, "u", "<p title=\"" * 500, "t"), (7, "u", "<nav>only a menu</nav>", "t"), (8, "u", "&#0;&#x1F600;&bogus; x", "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.main_text(spark, pages, weights).collect()
    found = {(r.page_id, r.n_chars): r.text for r in out}
    assert len(out) == len(rows) and found[1, 0] == found[2, 0] == found[7, 0] == "" and found[None, 16] == "plain words only" and found[5, 499_999].startswith("long")
    assert html_extract.main_text(spark, pages.limit(0), html_extract.train(spark, pages.limit(0))).count() == 0


def brute(rows, asks, k=10):
    good = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if asks(q):
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("spread", [0.0, 1.5])
def test_topk(spark, spread, monkeypatch):
    monkeypatch.setattr(topk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((6, 8))
    rows = [(k, ((centre[k % 6] + 0.2 * rng.standard_normal(8)) * np.exp(spread * rng.standard_normal())).tolist()) for k in range(400)]
    rows += [(1000 + k, rows[0][1]) for k in range(60)] + [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2010, [float("nan")] * 8), (2020, [float("inf")] * 8), (None, [1.0] * 8), (2030, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    from pyspark.sql import functions as F

    assert sorted(tuple(r) for r in topk.search(spark, df, F.col("vec_id") % 10 == 0).collect()) == brute(rows, lambda q: q % 10 == 0)
    few = df.filter("vec_id < 4")
    assert sorted(tuple(r) for r in topk.search(spark, few, F.col("vec_id") % 2 == 0).collect()) == brute([r for r in rows if r[0] is not None and r[0] < 4], lambda q: q % 2 == 0)
    assert topk.search(spark, df.limit(0), F.col("vec_id") % 2 == 0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.floats(0.1, 1.0))
def test_pruning_loses_nothing(seed, tight):
    rng = np.random.default_rng(seed)
    query = rng.integers(-50, 50, 5)
    vectors = query + rng.integers(-30, 30, (60, 5))
    norms = np.sqrt((vectors**2).sum(axis=1))
    order = np.argsort(-norms)
    vectors, norms = vectors[order], norms[order]
    score = vectors @ query
    floor = float(score.max() * tight)
    kept = set(topk.survivors(query, floor, vectors, norms).tolist())
    assert all(k in kept for k in np.flatnonzero(score >= floor))
