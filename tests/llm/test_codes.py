import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import codes, queries
from tests.llm.conftest import SMALL


def brute(rows):
    """rows: (vec_id, vector or None, label) -> (vec_id, code, error, label_error), and the codebooks' digest."""
    kept = [(d, [int(np.floor(4096 * float(x))) for x in v], lab) for d, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    step = -(-longest // 8)
    kept = [(d, v + [0] * (8 * step - len(v)), lab) for d, v, lab in kept]
    cut = lambda v, p: v[p * step : (p + 1) * step]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:16]
    books = [[cut(v, p) for _, v, _ in first] for p in range(8)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v, book: min((dist(v, e), k) for k, e in enumerate(book))
    for _ in range(6):
        for p in range(8):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, parts in own.items():
                books[p][k] = [sum(c) // len(parts) for c in zip(*parts)]
    out, sums = [], {}
    for d, v, lab in kept:
        found = [near(cut(v, p), books[p]) for p in range(8)]
        error = sum(x for x, _ in found)
        sums[lab] = sums.get(lab, 0) + error
        out.append((d, "".join(f"{k:02x}" for _, k in found), error, lab))
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((d, c, e, sums[lab]) for d, c, e, lab in out), key=str), digest


def found(spark, rows):
    docs = rows if hasattr(rows, "columns") else spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    coded, books = codes.encode(spark, docs)
    return sorted(((r.vec_id, r.code, r.error, r.label_error) for r in codes.label_errors(coded).collect()), key=str), codes.digest(books)


def test_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(int(k), [float(x) for x in rng.normal(size=24)], int(rng.integers(0, 3))) for k in rng.permutation(300)]
    rows += [(1000 + k, rows[0][1], None) for k in range(40)]  # copies, and no label
    rows += [(2000, None, 1), (2001, [float("nan")] * 24, 1), (2002, [None] * 24, 1), (2003, [float("-inf")] * 24, 1)]
    assert found(spark, rows) == brute(rows)


def test_ties_go_to_the_lower_index():
    book = np.array([[4, 0], [-4, 0], [4, 0], [0, 9]], np.int64)
    index, best = codes.nearest(np.array([[0, 0], [4, 1], [0, 9], [5, 0]], np.int64), book)
    assert index.tolist() == [0, 0, 3, 0] and best.tolist() == [16, 1, 0, 1]


def test_search_equals_full_search():
    rng = np.random.default_rng(6)
    for dims, entries in ((1, 16), (8, 16), (5, 3), (8, 1)):
        part, book = rng.integers(-20, 20, (500, dims)), rng.integers(-20, 20, (entries, dims))
        full = ((part[:, None] - book[None]) ** 2).sum(axis=2)
        for kind in (np.int64, object):
            index, best = codes.nearest(part.astype(kind), book.astype(kind))
            assert index.tolist() == full.argmin(axis=1).tolist() and best.tolist() == full.min(axis=1).tolist()


def test_odd(spark):
    rows = [(5, [0.1, 0.2, 0.3], 1), (None, [0.5] * 11, None), (5, [0.1, 0.2, 0.3], 1), (3, [], 2), (7, [2.0**40] * 9, 2), (8, [-(2.0**18), 1.0], None)]
    with pytest.raises(Exception, match="int|overflow|large|range"):  # an error beyond 64 bits
        found(spark, [*rows, *((k, [2.0**45 * k] * 8, 1) for k in range(20, 60))])
    assert found(spark, [rows[0], *rows[2:4]]) == brute([rows[0], *rows[2:4]])
    some = [rows[0], rows[1], rows[2], rows[3], rows[5], (9, [2.0**13, -(2.0**13)], 4)]
    assert found(spark, some) == brute(some)
    clash = spark.createDataFrame(some, "vec_id long, embedding array<double>, label int").withColumns({"vector": F.lit(1), "code": F.lit("x"), "error": F.lit(2), "slot": F.lit(3)})
    assert found(spark, clash) == brute(some)
    assert found(spark, [(1, [], None), (2, [], 3)]) == brute([(1, [], None), (2, [], 3)])
    assert found(spark, spark.createDataFrame([], "vec_id long, embedding array<double>, label int"))[0] == []


def test_query_and_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{SMALL}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.op12_vector_codes(spark, SMALL).collect())
    assert len(got) > 100 and got == sorted(db.execute(queries.OP12_SQL).fetchall())
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, digest = brute(rows)
    assert sorted(r[:4] for r in got) == sorted(want) and {r[4] for r in got} == {digest}
