import zlib

import numpy as np

from gondola.llm import segmentation


def test_checked_samples_hold_their_ids(spark, odd):
    docs = odd.filter("doc_id < 7")
    rows = segmentation.checked_samples(docs).collect()
    plain = sorted((r.doc_id, r.rank, r.ids) for r in segmentation.encode_samples(docs).collect() if r.doc_id)
    assert sorted((r.doc_id, r.rank, r.ids) for r in rows if r.doc_id) == plain
    assert all(len(r.ids) == r.n_pieces and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.decoded for r in rows)
