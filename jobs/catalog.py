"""The jobs as queries: each runs its job twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

from jobs import evaluate_retrieval, ingest_documents
from lodestone.plans.catalog import _CHUNKS, _HITS, _estimate, _pii_sql
from lodestone.plans.runtime import new_path

QUERIES, ORACLES = {}, {}


def job1_ingest_documents(spark, sf_dir):
    out = new_path(spark, "job1")
    for _ in range(2):
        ingest_documents.ingest(spark, f"{sf_dir}/documents.parquet", out, f"{out}/checkpoint")
    return ingest_documents.chunks(spark, out)


QUERIES["job1_ingest_documents"] = job1_ingest_documents
ORACLES["job1_ingest_documents"] = f"""
WITH {_CHUNKS}
SELECT h.doc_id, h.source, chunk_index, h.text, content_hash, {_estimate('h.text')} AS tokens, 0::BIGINT AS batch, lang FROM h JOIN documents d ON d.doc_id = h.doc_id
QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY h.doc_id, chunk_index) = 1
"""


def job2_evaluate_retrieval(spark, sf_dir):
    out = new_path(spark, "job2")
    for _ in range(2):
        evaluate_retrieval.evaluate(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", out)
    return evaluate_retrieval.questions(spark, out)


QUERIES["job2_evaluate_retrieval"] = job2_evaluate_retrieval
ORACLES["job2_evaluate_retrieval"] = (
    _HITS
    + f", masked_best AS ({_pii_sql('best', 'query_id, rank, source')})"
    + ", context AS (SELECT query_id, string_agg('[片段' || rank || '｜来源:' || source || ']' || chr(10) || masked, chr(10) || chr(10) ORDER BY rank) AS context FROM masked_best GROUP BY query_id)"
    + " SELECT hit.query_id, len(want)::INTEGER AS expected, source_hit, keyword_hit, best.source AS best_source, context, 'nightly' AS label"
    + " FROM hit JOIN want USING (query_id) LEFT JOIN best ON best.query_id = hit.query_id AND best.rank = 1 LEFT JOIN context ON context.query_id = hit.query_id"
)
