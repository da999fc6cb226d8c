import hashlib
import string

import duckdb
import numpy as np
from pyspark.sql import functions as F

from gondola.llm import line_dedup, queries
from gondola.llm.common import Workspace
from tests.llm.conftest import ODD, SMALL

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(docs, least=line_dedup.LEAST):
    """docs: (doc_id, text) -> (doc_id, n_lines, n_dropped, kept text) of each."""
    rank = lambda d: float("inf") if d is None else d
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for d, text in docs:
        for line in (text or "").split("\n"):
            k = key(line)
            if len(k) >= least:
                first[k] = min(first.get(k, float("inf")), rank(d))
    out = []
    for d, text in docs:
        every = (text or "").split("\n")
        kept = [x for x in every if len(key(x)) < least or first[key(x)] == rank(d)]
        out.append((d, len(every), len(every) - len(kept), "\n".join(kept)))
    return out


def found(rows):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in rows.collect()), key=str)


def test_lines_of_the_first_document_stay(spark):
    rng = np.random.default_rng(3)
    pool = [f"Line number {k} of a pool" for k in range(40)] + ["short", "", "  ", "\tPADDED line of words \r", "padded LINE of words", "ÄÖÜ ÀÉ Îøæ ÅÇ", "äöü àé îøæ åç", "the hot line of them all"]
    docs = [(int(d), "\n".join(rng.choice(pool, int(rng.integers(0, 12))).tolist() + ["the hot line of them all"] * int(rng.integers(0, 3)))) for d in rng.permutation(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(brute(docs), key=str)
    assert sum(r[2] for r in want) > 500
    for batches in (1, 5):
        assert found(line_dedup.dedup(spark, rows, batches=batches)) == want
    assert found(line_dedup.dedup(spark, rows, least=5)) == sorted(brute(docs, 5), key=str)


def test_odd(spark, odd, nothing):
    more = [(20, "tab\tand wide  gaps \n\n  TAB\tand wide  gaps"), (None, "one line for nobody\nonly here, for nobody"), (None, "only here, for nobody"), (21, "one line for nobody"), (21, "one line for nobody\nx"), (22, "x\n" * 50_000 + "one line for nobody")]
    clash = odd.select("doc_id", "text", F.lit(1).alias("n_lines"), F.lit(2).alias("place"), F.lit("h").alias("h1"), F.lit("b").alias("batch"))
    rows = clash.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True)
    out = line_dedup.dedup(spark, rows)
    assert out.columns == ["doc_id", "text", "place", "h1", "batch", "n_lines", "n_dropped", "kept_text"]
    assert found(out) == sorted(brute([r[:2] for r in ODD] + more), key=str)
    assert line_dedup.dedup(spark, nothing).count() == 0
    nobody = spark.createDataFrame([(None, "a line of nobody's\na line of nobody's"), (None, "a line of nobody's")], "doc_id long, text string")
    assert [r.n_dropped for r in line_dedup.dedup(spark, nobody).collect()] == [0, 0]


def test_runs_are_levelled_and_merged_without_a_shuffle(spark):
    index = line_dedup.LineIndex(spark, Workspace(spark, "levels"), fanout=2)
    batch = lambda k: line_dedup.lines(spark.createDataFrame([(10 * k + d, f"line of batch {k}, {d}\nline of every batch\nline of batch {k - 1}, {d}") for d in range(5)], "doc_id long, text string"))
    dropped, shapes = [], []
    for k in range(7):
        dropped.append(index.add(batch(k)).count())
        shapes.append([len(level) for level in index.levels])
    assert dropped == [4, *[10] * 6]
    assert shapes == [[1], [2], [1, 1], [2, 1], [1, 0, 1], [2, 0, 1], [1, 1, 1]]
    keys = [set(map(tuple, spark.table(run).select("h1", "h2").collect())) for run in index._runs()]
    assert sum(map(len, keys)) == len(set.union(*keys)) == 5 * 8 + 1
    with line_dedup._sorted_scans(spark):
        a, b = (spark.table(run) for run in index._runs()[:2])
        plan = a.join(b.select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    index.close()


def test_query_and_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{SMALL}/documents.parquet'")
    got = sorted(tuple(r) for r in queries.op13_line_dedup(spark, SMALL).collect())
    assert got == sorted(db.execute(queries.OP13_SQL).fetchall())
    docs = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((d, n, gone, hashlib.sha256(text.encode()).hexdigest()) for d, n, gone, text in brute(docs))
