import math
import re

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gondola.llm import queries, ranked_search
from tests.llm.conftest import ODD, SMALL

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items, k=10):
    """docs: (doc_id, text), items: (item_id, text) -> (item_id, rank, doc_id, score)."""
    split = lambda text: TERM.findall((text or "").translate(LOWER))
    bags = [(d, split(text)) for d, text in docs]
    n, total = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df, own = {}, {}
    for _, bag in bags:
        for t in set(bag):
            df[t] = df.get(t, 0) + 1
    for item, text in items:
        own.setdefault(item, set()).update(split(text))
    out = []
    for item, asked in own.items():
        scores = []
        for d, bag in bags:
            score = 0
            for t in asked & set(bag):
                m, tf = 10 + 90 * len(bag) * n // total, bag.count(t)
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, d is None, d or 0))
        out += [(item, rank, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def found(spark, docs, items, **shards):
    index, documents = ranked_search.build(spark, docs, **shards)
    return sorted((tuple(r) for r in ranked_search.search(spark, index, documents, items, query_bytes=2000).collect()), key=str)


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Ärger", "naïve", "ONE", "one"]
    weight = 1 / np.arange(1, len(words) + 1)
    return [(int(k), " ".join(rng.choice(words, int(rng.integers(0, 60)), p=weight / weight.sum()))) for k in rng.permutation(n)]


def test_against_brute_force(spark):
    rng = np.random.default_rng(8)
    docs = corpus(rng, 400)
    docs += [(1000 + k, docs[3][1]) for k in range(30)]  # ties
    items = [(k, text) for k, (_, text) in enumerate(corpus(rng, 12))] + [(50, "nothing that is held"), (51, ""), (3, "w9 w9 w10")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert found(spark, rows, asked) == want
    assert found(spark, rows, asked, postings=300, most=16) == want


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)

    def price(x, cuts, cost):
        return sum(cost + max(x[a:b]) * (b - a) - sum(x[a:b]) for a, b in zip(cuts, cuts[1:]))

    lists = [rng.integers(1, 100, int(n)) for n in (1, 2, 3, 7, 8, 8, 9, 10)]
    lengths = np.array([len(x) for x in lists])
    starts = np.cumsum(lengths) - lengths
    for most, cost in ((4, 30), (32, 90), (1, 5)):
        flags = ranked_search.boundaries(np.concatenate(lists), starts, lengths, most, cost)
        for x, a in zip(lists, starts):
            cuts = [0, *(np.flatnonzero(flags[a : a + len(x)]) + 1).tolist()]
            assert cuts[-1] == len(x) and max(np.diff(cuts)) <= most
            every = [[0, *[k for k in range(1, len(x)) if mask >> k & 1], len(x)] for mask in range(0, 1 << len(x), 2)]
            assert price(x, cuts, cost) == min(price(x, c, cost) for c in every if max(np.diff(c)) <= most)


def test_blocks_are_skipped(spark):
    rng = np.random.default_rng(2)
    docs = [(k, " ".join(["common"] * int(rng.integers(1, 5)) + [f"x{rng.integers(300)}" for _ in range(int(rng.integers(5, 200)))])) for k in range(3000)]
    index, n = ranked_search.build(spark, spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    rows = index.filter(F.col("term").isin(bytearray(b""), bytearray(b"common"), bytearray(b"x7"))).toArrow()
    lists = ranked_search.Lists(rows, {b"common": 0, b"x7": 1})
    top, decoded, blocks = ranked_search.best(lists, [(lists.at[0], 5), (lists.at[1], 4000)], 10)
    assert [(3, d, s) for d, s in top] and decoded < blocks / 2


def test_odd(spark, odd, nothing):
    items = [(1, None), (2, ""), (None, "one"), (None, "two"), (4, "tab wide über ärger hunter22 x"), (5, "A" * 120_000), (5, "1234"), (6, "İ i̇ çà")]
    clash = odd.select("doc_id", "text", F.lit(1).alias("term"), F.lit(2).alias("shard"), F.lit(3).alias("item_id"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit(2), "rank": F.lit(3)})
    assert found(spark, clash, asked) == brute([r[:2] for r in ODD], items)
    assert found(spark, nothing, asked) == [] and found(spark, odd, asked.limit(0)) == []


def test_query_and_sql(spark):
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"CREATE VIEW {t} AS FROM '{SMALL}/{t}.parquet'")
    got = sorted(tuple(r) for r in queries.op11_ranked_search(spark, SMALL).collect())
    assert len(got) > 100 and got == sorted(db.execute(queries.OP11_SQL).fetchall())
