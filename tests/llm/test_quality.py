import math

import numpy as np
from pyspark.sql import functions as F

from gondola.llm import quality


def rows_of(spark, x, y):
    data = [(k, [float(v) for v in r], float(l)) for k, (r, l) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "doc_id long, row array<double>, label double").repartition(23)


def test_features_approximate_the_gaussian_kernel():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, quality.STATISTICS))
    z = quality.expanded(x)[:, : quality.FEATURES]
    width = quality.WIDTH * math.sqrt(quality.STATISTICS)
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(axis=2) / (2 * width**2))
    assert np.abs(z @ z.T - kernel).mean() < 0.06 and quality.expanded(x).shape[1] == quality.FEATURES + 1


def test_weights_solve_the_normal_equations_of_all_rows(spark, monkeypatch):
    """Against one solution over all rows at once, with sums taken three at a time."""
    monkeypatch.setattr(quality, "FAN", 3)
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, quality.STATISTICS)) * 3 + 1, rng.integers(0, 2, 300)
    rows = rows_of(spark, x, y)
    model = quality.train(spark, rows)
    held = {r.doc_id for r in rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0).collect()}
    own = np.array([k not in held for k in range(300)])
    assert np.allclose(model.mean, x.mean(axis=0)) and np.allclose(model.scale, x.std(axis=0))
    z = quality.expanded((x[own] - x.mean(axis=0)) / x.std(axis=0))
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * own.sum() * np.eye(z.shape[1]), z.T @ y[own])
    assert np.allclose(model.weights, weights, atol=1e-6)


def test_labels_that_no_line_separates(spark):
    """Rows around the centre are good, all others bad: a linear score can't tell them apart."""
    rng = np.random.default_rng(3)
    x = np.zeros((3000, quality.STATISTICS))
    x[:, :2] = rng.uniform(-2, 2, (3000, 2))
    y = (np.abs(x[:, :2]).max(axis=1) < 1.2).astype(int)
    model = quality.train(spark, rows_of(spark, x[:2000], y[:2000]))
    predicted = model.score(x[2000:]) >= 0.5
    line = np.linalg.lstsq(np.c_[x[:2000, :2], np.ones(2000)], y[:2000], rcond=None)[0]
    straight = np.c_[x[2000:, :2], np.ones(1000)] @ line >= 0.5
    assert (predicted == y[2000:]).mean() > 0.9 > 0.75 > (straight == y[2000:]).mean()


def test_equal_texts_get_equal_scores_and_order_is_kept(spark):
    texts = ["Plain words of a good text, with sentences. " * 5, "### $$$ 123 !!! " * 9, "", None, "Plain words of a good text, with sentences. " * 5, "word " * 40_000]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(0, 1), (1, 0), (4, 1)], "doc_id long, quality int")
    found = {r.doc_id: r.score for r in quality.classify(spark, docs, labels).collect()}
    assert found[0] == found[4] and found[2] == found[3] and len(found) == len(texts) and all(0 <= s <= 1 for s in found.values())
