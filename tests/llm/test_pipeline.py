from pyspark.sql import functions as F

import corpus_pipeline
from gondola.llm import langid, secrets
from tests.llm.test_minhash import brute_components
from tests.llm.test_packing import check


def test_pipeline_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = langid.train(spark, docs.filter(corpus_pipeline.id_bucket("doc_id", 4) != 2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rejected = model.predict([t for _, t in rows])[2]
    rows = [r for r, bad in zip(rows, rejected) if not bad]
    last = {}
    for d, t in sorted(rows):
        last[t] = d
    rows = [(d, t) for t, d in last.items()]
    names = brute_components(rows)  # five-word shingles, similarity 0.8 or more
    rows = [(d, secrets.redacted(t)) for (d, t), c in zip(rows, names) if d == c]
    check(corpus_pipeline.run(spark, small).collect(), rows)


def test_stages_keep_columns(spark, small, odd):
    docs = odd.withColumnRenamed("kept", "n_chars").withColumn("source", odd["lang"]).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.columns == docs.columns
        out.count()


def test_columns_of_any_name_stay(spark, small):
    """Columns named like the operators' own come through every stage but the last as they were."""
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(60)
    names = {"score": "mine", "rejected": "no", "lang_pred": "xx", "kept": "k", "fp": "f", "key": "y", "root": "r", "group_size": "g", "spans": "s"}
    docs = docs.withColumns({k: F.lit(v) for k, v in names.items()})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, small)
        assert out.schema == docs.schema
        assert {tuple(r) for r in out.select(*names).distinct().collect()} == {tuple(names.values())}
    assert "ids" in corpus_pipeline.packed(spark, docs, small).columns


def test_odd_rows_and_empty_tables(spark, odd, small):
    docs = odd.withColumnRenamed("kept", "n_chars").withColumn("source", odd["lang"]).select("doc_id", "text", "lang", "source", "n_chars")
    again = docs.unionByName(docs)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), small).count() == 0
        assert stage(spark, again, small).count() > 0
