import itertools
import math

import numpy as np

from gondola.llm import queries
from gondola.llm import segmentation as sg
from tests.llm.conftest import ODD


def vocab():
    return sg.vocabulary(sg.model_path(), sg.TEMPERATURE)


def every(word):
    """All segmentations of one word with their log-weights."""
    v = vocab()
    score = {v.model.id_to_piece(k): -math.log(2 - min(0.0, v.model.get_score(k))) / sg.TEMPERATURE for k, _ in v.weights.values()}

    def go(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            own = score.get(rest[:n], v.fallback * len(rest.encode()[: len(rest[:1].encode())]) if n == 1 else None)
            if own is not None:
                for tail, w in go(rest[n:]):
                    yield (rest[:n], *tail), own + w

    return dict(go(word))


def test_probabilities_are_those_of_all_segmentations():
    text = "these was é͸"
    words = sg.split_words(text)
    assert words == ["▁these", "▁was", "▁é͸"]
    parts = [every(w) for w in words]
    whole = {tuple(itertools.chain(*p)): sum(d[x] for d, x in zip(parts, p)) for p in itertools.product(*parts)}
    total = math.log(sum(map(math.exp, whole.values())))
    counts, n = {}, 400
    for key in range(n):
        found = list(sg.samples([key], [text], vocab(), 4))
        assert len({tuple(f[2].tolist()) for f in found}) == 4 and [f[4] for f in found] == sorted((f[4] for f in found), reverse=True)
        for _, rank, ids, logp, _, inclusion in found:
            assert vocab().model.decode(ids.tolist()) == text and 0 < inclusion <= 1
            if rank == 1:
                counts[round(logp, 6)] = counts.get(round(logp, 6), 0) + 1
    truth = {}
    for w in whole.values():
        truth[round(w - total, 6)] = truth.get(round(w - total, 6), 0) + math.exp(w - total)
    assert set(counts) <= set(truth)
    for logp, p in truth.items():  # the first is a plain sample
        assert abs(counts.get(logp, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 0.005


def test_inclusion_estimates_are_unbiased():
    text = "these nth"
    ones = [sum(math.exp(f[3]) / f[5] for f in list(sg.samples([key], [text], vocab(), 6))[:]) for key in range(300)]
    assert abs(np.mean(ones) - 1) < 0.1  # sum of p / inclusion over a sample estimates 1


def test_all_when_few():
    found = list(sg.samples([3, 4, None], ["a", "", None], vocab(), 5))
    first = [f for f in found if f[0] == 0]
    assert len(first) == len(every("▁a")) and {f[5] for f in first} == {1.0} and abs(sum(math.exp(f[3]) for f in first) - 1) < 1e-9
    assert [(f[0], len(f[2]), f[5]) for f in found if f[0]] == [(1, 0, 1.0), (2, 0, 1.0)]


def test_query_round_trip(spark, small, documents):
    rows = queries.op3_segmentation(spark, small).collect()
    assert {r.doc_id for r in rows} == {d for d, _, _ in documents} and all(r.decoded for r in rows)
    again = queries.op3_segmentation(spark, small).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_odd(spark, odd, nothing):
    back = {(r.doc_id, r.text) for r in sg.decode(sg.encode_samples(odd)).collect()}
    assert back == {(r[0], r[1] or "") for r in ODD}
    assert {(r.doc_id, r.text) for r in sg.decode(sg.encode(odd)).collect()} == back
    assert sg.encode_samples(nothing).count() == 0 and sg.decode(sg.encode(nothing)).count() == 0
