"""Batches of packages that a Python worker holds are bounded by their bytes, not by their number."""

import pyarrow as pa

from gondola.session import tune


def test_batches_of_packages_are_small(spark):
    rows = tune(spark).range(64, numPartitions=1).selectExpr("CAST(id AS STRING) AS source_package", "CAST(repeat('x', 1000000) AS BINARY) AS content")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "bytes": [batch.nbytes]})

    found = rows.mapInArrow(sizes, "n long, bytes long").collect()
    assert sum(r.n for r in found) == 64 and max(r.bytes for r in found) < 12_000_000
