import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import topk


def test_large_components_take_part(spark):
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    rows += [(1000, [0.0, *[3e6] * 7]), (1001, [2.0**40, *[0.0] * 7]), (1002, [-(2.0**41), *[0.0] * 7]), (1003, [float("inf")] * 8), (1004, [2097152.0, *[0.0] * 7])]
    found = topk.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()
    x = {k: [int(np.floor(1024 * c)) for c in v] for k, v in rows if k != 1003}
    want = []
    for q in (0, 100, 200, 1000):
        scores = sorted((-sum(a * b for a, b in zip(x[q], v)), k) for k, v in x.items() if k != q)[:10]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == want
    assert {1000, 1001, 1002, 1004} & {k for _, _, k, _ in want} >= {1000, 1001, 1004}


def test_scores_beyond_64_bits_are_an_error():
    big = np.array([[2**40, 2**40]], np.int64)
    with pytest.raises(OverflowError):
        topk.best(np.array([0]), big, np.array([topk.LOW]), np.array([1]), big, 10)


def test_mixed_dimensions(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=(2, 4, 6)[k % 3])]) for k in range(90)] + [(500, []), (501, [1.0])]
    docs = spark.createDataFrame([(k, v, 3, 4) for k, v in rows], "vec_id long, embedding array<double>, part int, dim int")
    found = topk.search(spark, docs, F.col("vec_id") % 10 == 0).collect()
    x = {k: [int(np.floor(1024 * c)) for c in v] for k, v in rows if v}
    want = []
    for q in [k for k in x if k % 10 == 0]:
        scores = sorted((-sum(a * b for a, b in zip(x[q], v)), k) for k, v in x.items() if k != q and len(v) == len(x[q]))[:10]
        want += [(q, rank, k, -s) for rank, (s, k) in enumerate(scores, 1)]
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found) == sorted(want)


def test_blocks_meet_only_buckets_that_can_matter(spark, monkeypatch):
    """Lengths spread over orders of magnitude: most (block, bucket) pairs are pruned before the shuffle."""
    monkeypatch.setattr(topk, "BUCKET_ROWS", 50)
    monkeypatch.setattr(topk, "MOST_ROWS", 50)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 20)
    rng = np.random.default_rng(6)
    rows = [(k, (rng.normal(size=4) * 10 ** rng.uniform(0, 3)).tolist()) for k in range(4000)]
    seen = []
    meetings = topk.meetings
    monkeypatch.setattr(topk, "meetings", lambda blocks, sizes: seen.append((blocks.count(), sizes.agg(F.sum("parts")).first()[0], meetings(blocks, sizes).count())) or meetings(blocks, sizes))
    found = topk.search(spark, spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect()
    blocks, buckets, copies = seen[0]
    assert blocks >= 20 and buckets >= 80 and copies < 0.25 * blocks * buckets
    x = {k: np.floor(1024 * np.array(v)).astype(np.int64) for k, v in rows}
    every, ids = np.array(list(x.values())), np.array(list(x))
    by_query = {}
    for r in found:
        by_query.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in ids[ids % 10 == 0].tolist():
        score = every @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:10]
        assert sorted(by_query[q]) == [(n, int(ids[i]), int(score[i])) for n, i in enumerate(order, 1)]
