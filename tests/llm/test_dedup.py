import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import exact_dedup, graph, minhash, queries, simhash
from gondola.llm.common import Workspace
from gondola.llm.exact_dedup import CountingQuotientFilter, merged
from tests.llm.conftest import ODD


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 50).map(lambda k: k << 58), min_size=1), min_size=1, max_size=5))
def test_filters_merge_losslessly(parts):
    filters, truth = [], defaultdict(int)
    for part in parts:
        values, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        filters.append(CountingQuotientFilter.of(values, counts, 10))
        assert (filters[-1].fingerprints() == values).all()
        for x in part:
            truth[x] += 1
    values, counts = merged(filters)
    assert dict(zip(values.tolist(), counts.tolist())) == dict(truth) and (values[1:] > values[:-1]).all()
    cut = [f.range(k * 256, 256, f.fingerprints()) for f in filters for k in range(4)]
    assert merged(cut)[1].sum() == sum(map(len, parts))


def brute_exact(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return {t: (max((x for x in ids if x is not None), default=None), len(ids)) for t, ids in groups.items()}


def test_exact_on_odd_rows(spark, odd):
    rows = exact_dedup.annotate(spark, odd).collect()
    truth = brute_exact([(r[0], r[1]) for r in ODD])
    assert len(rows) == len(ODD)
    kept = defaultdict(int)
    for r in rows:
        assert (r.keep_id, r.group_size) == truth[r.text or ""] and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        kept[r.text or ""] += r.kept
    assert set(kept.values()) == {1}
    stays = exact_dedup.dedup(spark, odd)
    assert stays.columns == odd.columns and sorted(str(r.text or "") for r in stays.collect()) == sorted(truth)


def test_exact_salted_path(spark, odd, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_ROWS", 0)
    assert sum(r.kept for r in exact_dedup.annotate(spark, odd).collect()) == len(brute_exact([(r[0], r[1]) for r in ODD]))


def test_exact_empty(spark, nothing):
    assert exact_dedup.annotate(spark, nothing).count() == 0 and exact_dedup.dedup(spark, nothing).count() == 0


def brute_fingerprint(text):
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """prints: (doc_id, fingerprint) -> component of each row."""
    parent = list(range(len(prints)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for k, (doc_id, _) in enumerate(prints):
        if doc_id is not None:
            least[root(k)] = min(doc_id, least.get(root(k), doc_id))
    return [least.get(root(k)) for k in range(len(prints))]


def test_simhash_query(spark, small, documents):
    prints = [(d, brute_fingerprint(t)) for d, t, _ in documents]
    truth = {d: (f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints))}
    rows = queries.op2_simhash(spark, small).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == truth and len(rows) == len(documents)


def test_simhash_odd(spark, odd, nothing):
    prints = [(r[0], brute_fingerprint(r[1])) for r in ODD]
    truth = sorted((str(d), f, c) for (d, f), c in zip(prints, brute_components(prints)))
    assert sorted((str(r.doc_id), r.fp % 2**64, r.component_id) for r in simhash.classes(spark, odd).collect()) == truth
    assert simhash.classes(spark, nothing).count() == 0 and simhash.dedup(spark, nothing).count() == 0
    assert simhash.dedup(spark, odd).columns == odd.columns


def test_one_row_of_each_component_stays(spark):
    """By row, not by id: ids that repeat, null ids and whole rows that repeat."""
    a, b, c = "one two three four five six", "nothing like the other text at all", "a third one that has its own words"
    rows = [(1, a, "x"), (5, a, "x"), (5, b, "x"), (None, a, "x"), (None, b, "y"), (None, c, "y"), (None, c, "z"), (7, None, "x"), (7, "", "x"), (8, "  ", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root string")
    for near in (simhash.dedup, minhash.dedup):
        kept = near(spark, docs).collect()
        assert near(spark, docs).columns == docs.columns
        assert sorted((str(r.doc_id), r.text or "") for r in kept) == sorted([("1", a), ("5", b), ("None", c), ("7", "")])


def test_links_reach_all_pairs(spark):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 2**63, 20, dtype=np.int64)
    fps = {int(s) for s in seeds} | {int(s ^ (np.int64(1) << a) ^ (np.int64(1) << b)) for s in seeds for a, b in rng.integers(0, 63, (6, 2)).tolist()}
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    space = Workspace(spark, "test")
    labels = {r.node: r.label for r in graph.components(space, simhash.links(nodes)).collect()}
    order = sorted(fps)
    least = brute_components([(k, f % 2**64) for k, f in enumerate(order)])
    mine = [labels.get(f, f) for f in order]
    assert mine == [order[k] for k in least]


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in graph.components(Workspace(spark, "test"), edges).collect()}
    assert labels == {k: 0 for k in range(201)} | {500: 500, 501: 500}
