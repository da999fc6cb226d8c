import numpy as np

import corpus_pipeline
from gondola.llm import minhash, simhash
from gondola.llm.common import Workspace
from tests.llm.conftest import ODD


def brute_components(docs):
    """docs: (doc_id, text) -> component of each row, by five-word Jaccard similarity of 0.8 or more."""
    sets = []
    for _, text in docs:
        words = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode("utf-8", "surrogatepass")).split()
        sets.append(frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    ids = {}
    for (d, _), x in zip(docs, label):
        if d is not None:
            ids[x] = min(d, ids.get(x, d))
    return [ids.get(x) for x in label]


def versions():
    """Texts with versions of about 0.5 to 1, a chain of versions, and many versions of one text that are mostly not alike."""
    rng, out = np.random.default_rng(5), []
    word = lambda n: [f"w{x}" for x in rng.integers(0, 10**6, n)]
    for _ in range(12):
        base = word(int(rng.integers(30, 400)))
        out.append(base)
        for share in (0.005, 0.01, 0.02, 0.04, 0.08):
            out.append([w if rng.random() > share else f"x{rng.integers(10**6)}" for w in base])
    chain = word(200)
    for k in range(8):
        out.append(chain[12 * k :] + word(12 * k))
    template = word(100)
    for _ in range(60):
        out.append(template + word(int(rng.integers(5, 45))))
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def test_pairs_of_similarity_are_joined(spark):
    docs = versions()
    truth = dict(zip([d for d, _ in docs], brute_components(docs)))
    assert len(set(truth.values())) < len(docs) - 30
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in minhash.classes(spark, rows).collect()} == truth
    kept = {r.doc_id for r in corpus_pipeline.near(spark, rows, "").collect()}
    assert kept == set(truth.values())


def test_odd(spark, odd, nothing):
    truth = sorted((str(r[0]), c) for r, c in zip(ODD, brute_components([r[:2] for r in ODD])))
    assert sorted((str(r.doc_id), r.component_id) for r in minhash.classes(spark, odd).collect()) == truth
    assert minhash.classes(spark, nothing).count() == 0 and minhash.dedup(spark, nothing).count() == 0
    assert minhash.dedup(spark, odd).columns == odd.columns


def test_balls_are_buckets(spark):
    """Nodes within two bits share a bucket whatever their bands are; a fingerprint is that of the node's shingle set."""
    rows = spark.createDataFrame([(d, t, None) for d, t in versions()[:12]], "doc_id long, text string, key binary")
    found = rows.mapInArrow(minhash._describe, "doc_id long, fp long, n long, sim long, bands array<long>, text string, key binary").collect()
    assert [r.sim for r in found] == simhash.prints([minhash.shingle_set(r.text) for r in found]).view(np.int64).tolist()
    nodes = [(1, 9, 0b1011, [11]), (2, 9, 0b1000, [12]), (3, 9, 0b111111 << 20, [13]), (4, 9, 0b1011, [14]), (5, 0, 0, [])]
    space = Workspace(spark, "test")
    placed = minhash.buckets(space, spark.createDataFrame(nodes, "fp long, n long, sim long, bands array<long>")).collect()
    ball = {r.fp: r.key for r in placed if r.band == 0}
    assert ball[1] == ball[2] == ball[4] != ball[3] and 5 not in ball
    assert {(r.fp, r.key) for r in placed if r.band == 1} == {(1, 11), (2, 12), (3, 13), (4, 14)}


def test_small_buckets_need_no_filter(spark, monkeypatch):
    """Texts that share a small bucket without being alike are paired there; their shingles don't go through the filter."""
    rng, docs, left = np.random.default_rng(8), [], []
    for _ in range(60):
        base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
        docs += [base, base[:80] + [f"x{x}" for x in rng.integers(0, 10**6, 20)], [*base[2:], "y"]]
    docs = [(k, " ".join(w)) for k, w in enumerate(docs)]
    filtered = minhash._prefixes
    monkeypatch.setattr(minhash, "_prefixes", lambda space, nodes, *more: left.append(nodes.count()) or filtered(space, nodes, *more))
    found = {r.doc_id: r.component_id for r in minhash.classes(spark, spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert found == dict(zip([d for d, _ in docs], brute_components(docs))) and left == [0]


def test_texts_are_gathered_once(spark, monkeypatch):
    """Only texts whose node shares a bucket are kept for the steps that verify, in one table."""
    docs, written, write = [(k, f"alone {k} " + " ".join(f"v{k}x{j}" for j in range(20))) for k in range(30)], {}, Workspace.write
    docs += [(100, docs[0][1] + " z"), (101, docs[1][1])]

    def noted(self, df, name, *more):
        written[name] = write(self, df, name, *more)
        return written[name]

    monkeypatch.setattr(Workspace, "write", noted)
    found = minhash.classes(spark, spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in found.collect() if r.component_id != r.doc_id} == {100, 101}
    assert {r.text for r in written["texts"].collect()} == {docs[0][1], docs[0][1] + " z"}
