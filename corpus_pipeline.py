"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, secrets, packing.

Each stage works on all rows that the stage before it has kept, and its decisions take effect: toxic documents
go, one document of each near-duplicate class stays, contaminated documents go, secrets are replaced in the
texts (n_chars follows), and what is left is tokenized and packed. All stages but the last return the columns
that they were given, and a stage's table is deleted when the next one is written.

Rows without a text pass through all stages: they are clean, have no words that could be copied or contaminated,
and pack as their end id. Rows without an id but with words take part as any other (see near_dup). Extra columns stay as
they are until packing; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from forecourt.llm import decontaminate, near_dup, packing, secrets, toxicity
from forecourt.llm.common import discard, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_contaminated), ("secrets", redact_secrets), ("packing", pack)]

#: Learned scores and sampled sketches can't be written in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # of a stage; the corpus itself stays
    return docs
