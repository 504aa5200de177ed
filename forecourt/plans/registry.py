"""All registered queries of the library and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.operators import retrieval
from forecourt.plans import agent_queries, assembly_queries, dialogue_queries, evaluation_queries, ingest_queries, record_queries, retrieval_queries, stream_queries

MODULES = (retrieval_queries, dialogue_queries, evaluation_queries, record_queries, assembly_queries, agent_queries, stream_queries, ingest_queries)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in MODULES for k, q in m.ORACLES.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered vector top-k, joined to the documents of the same id and formatted."""
    query = retrieval_queries.query_vector(spark, sf_dir)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("label") == 3)
    best = retrieval.top_k(vectors, query, 10).select("vec_id", "score")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    joined = docs.join(F.broadcast(best), docs["doc_id"] == best["vec_id"])  # ten rows
    return retrieval.format_results(joined, "source", "text")
