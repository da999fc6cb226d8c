"""The queries of this subpackage, each over its whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm import codes, exact_dedup, html_extract, langid, line_dedup, packing, quality, ranked_search, secrets, segmentation, simhash, suffix_dedup, topk
from gondola.llm.common import id_bucket, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.annotate(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.classes(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three distinct sampled segmentations of every text: ids, with their number, checksum and whether they decode to the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return segmentation.checked_samples(docs)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"), with_ids=False)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_extract.main_text(spark, pages.select("page_id", "url", "html"), html_extract.train(spark, pages))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(id_bucket("doc_id", 3) != 1)
    return quality.classify(spark, table(spark, sf_dir, "documents"), labels).select("doc_id", (id_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP8_SQL = """
WITH v AS (
    SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS x
    FROM embeddings
    WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([p[1] * p[2] for p in list_zip(q.x, c.x)]) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", suffix_dedup.digest().alias("kept_sha256"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_bucket("doc_id", 4) == 2
    model = langid.train(spark, docs.filter(~held_out))
    return langid.classify(spark, docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, documents = ranked_search.build(spark, table(spark, sf_dir, "documents"))
    return ranked_search.search(spark, index, documents, table(spark, sf_dir, "benchmark"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH t AS (
    SELECT rid, doc_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS rid, doc_id, text FROM documents)
), p AS (
    SELECT rid, doc_id, term, count(*) AS tf FROM t GROUP BY ALL
), d AS (
    SELECT rid, CAST(sum(tf) AS BIGINT) AS terms FROM p GROUP BY rid
), s AS (
    SELECT count(*) AS documents, CAST(sum(terms) AS BIGINT) AS total FROM d
), w AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(documents) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM p, s GROUP BY term
), q AS (
    SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark
), r AS (
    SELECT item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * terms * documents) // total)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN p USING (term) JOIN d USING (rid), s GROUP BY ALL
), o AS (
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10
"""


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.encode(spark, table(spark, sf_dir, "embeddings"))
    return codes.label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def _op12_sql() -> str:
    """One pair of CTEs (assignment, new codebook) for each round, and a last assignment."""
    rounds = []
    for k in range(codes.ROUNDS + 1):
        rounds.append(f"""
d{k} AS MATERIALIZED (
    SELECT x.vec_id, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS dist
    FROM x JOIN c{k} AS c ON x.part = c.part AND x.place = c.place GROUP BY ALL
), a{k} AS MATERIALIZED (
    SELECT vec_id, part, entry, dist FROM d{k} QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) = 1
)""")
        if k < codes.ROUNDS:
            rounds.append(f"""
m{k} AS (
    SELECT a.part, a.entry, x.place, sum(x.v)::HUGEINT AS s, count(*)::HUGEINT AS n
    FROM a{k} AS a JOIN x ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY ALL
), c{k + 1} AS MATERIALIZED (
    SELECT c.part, c.entry, c.place, CASE WHEN m.n IS NULL THEN c.v ELSE ((m.s - ((m.s % m.n) + m.n) % m.n) // m.n)::BIGINT END AS v
    FROM c{k} AS c LEFT JOIN m{k} AS m ON c.part = m.part AND c.entry = m.entry AND c.place = m.place
)""")
    last = codes.ROUNDS
    return f"""
WITH kept AS (
    SELECT vec_id, label, [CAST(floor({codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS whole
    FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), u AS (
    SELECT vec_id, len(whole) // {codes.PARTS} AS step, unnest(whole) AS v, generate_subscripts(whole, 1) - 1 AS spot FROM kept
), x AS MATERIALIZED (
    SELECT vec_id, spot // step AS part, spot % step AS place, v FROM u
), f AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept ORDER BY vec_id LIMIT {codes.ENTRIES}
), c0 AS MATERIALIZED (
    SELECT x.part, f.entry, x.place, x.v FROM f JOIN x ON f.vec_id = x.vec_id
),{",".join(rounds)}, e AS (
    SELECT vec_id, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a{last} GROUP BY vec_id
)
SELECT e.vec_id, e.code, e.error, CAST(sum(e.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, place)) FROM c{last}) AS codebooks_sha256
FROM e JOIN kept AS k ON e.vec_id = k.vec_id
"""


OP12_SQL = _op12_sql()


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = """
WITH s AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
    SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM s
), k AS (
    SELECT doc_id, line, place,
           translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key
    FROM l
), f AS (
    SELECT line_key, min(doc_id) AS first_id FROM k WHERE length(line_key) >= 10 GROUP BY line_key
), d AS (
    SELECT k.doc_id, k.line, k.place, f.first_id IS NOT NULL AND f.first_id <> k.doc_id AS gone FROM k LEFT JOIN f ON k.line_key = f.line_key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_simhash, op3_segmentation, op4_packing, op5_html, op6_secrets, op7_quality, op8_topk, op9_suffix_array, op10_language, op11_ranked_search, op12_vector_codes, op13_line_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op8_topk": OP8_SQL, "op11_ranked_search": OP11_SQL, "op12_vector_codes": OP12_SQL, "op13_line_dedup": OP13_SQL}
