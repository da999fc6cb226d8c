import zlib

import numpy as np

import corpus_pipeline


def test_packed_pieces_hold_their_ids(spark):
    docs = spark.createDataFrame([(1, "one two three"), (2, "four " * 3000), (3, None)], "doc_id long, text string")
    rows = corpus_pipeline.packed(spark, docs, "").collect()
    assert {r.doc_id for r in rows} == {1, 2, 3}
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
