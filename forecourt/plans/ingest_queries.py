"""Queries of chunked documents, audio files and the catalogue as a data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from forecourt.functions.semantics import truthy
from forecourt.operators import retrieval, speech
from forecourt.operators.chunks import LIMIT, OVERLAP, best_of_chunks, chunks
from forecourt.plans.agent_queries import BUCKETS_SQL
from forecourt.plans.retrieval_queries import TOML_SQL, car_documents, part_catalogue, table
from forecourt.sources import record_store, toml_data_source, wav_source

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: w: words; b: where sentences (cut at the limit) end; a chunk goes from the place numbered s to the one numbered e.
CHUNKS_SQL = f"""WITH RECURSIVE d AS (SELECT doc_id, lang, list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '([。！？])', '\\1 ', 'g'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
    ends AS (SELECT doc_id, len(w) AS n, list_filter(list_transform(w, lambda x, i: CASE WHEN i = len(w) OR regexp_matches(x, '[.!?。！？]["'')\\]]*$') THEN i END), lambda i: i IS NOT NULL) AS t FROM d WHERE len(w) > 0),
    places AS (SELECT doc_id, n, list_prepend(0, flatten(list_transform(t, lambda x, i: list_append(range(CASE WHEN i = 1 THEN 0 ELSE t[i - 1] END + {LIMIT}, x, {LIMIT}), x)))) AS b FROM ends),
    c AS (SELECT doc_id, 0 AS chunk, CAST(1 AS BIGINT) AS s, len(list_filter(b, lambda x: x <= {LIMIT})) AS e FROM places UNION ALL SELECT doc_id, chunk, s, len(list_filter(b, lambda x: x <= b[s] + {LIMIT})) FROM (
        SELECT c.doc_id, chunk + 1 AS chunk, b, greatest(s + 1, len(list_filter(b, lambda x: x < b[e] - {OVERLAP})) + 1, len(list_filter(b, lambda x: x < b[e + 1] - {LIMIT})) + 1) AS s FROM c JOIN places p ON p.doc_id = c.doc_id WHERE e < len(b))),
    chunked AS (SELECT doc_id, lang, CAST(chunk AS INTEGER) AS chunk, CAST(b[s] AS INTEGER) AS start, CAST(b[e] - b[s] AS INTEGER) AS n_tokens, array_to_string(w[b[s] + 1 : b[e]], ' ') AS text FROM c JOIN places USING (doc_id) JOIN d USING (doc_id))"""


@query(f"{CHUNKS_SQL} SELECT doc_id, chunk, start, n_tokens, sha256(text) AS chunk_sha256 FROM chunked")
def document_chunks(spark, sf_dir):
    own = chunks(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return own.select("doc_id", "chunk", "start", "n_tokens", F.sha2("chunk_text", 256).alias("chunk_sha256"))


@query(
    f"""{CHUNKS_SQL}, v AS (SELECT doc_id, lang, chunk, b, CAST(count(*) AS DOUBLE) AS n FROM (SELECT doc_id, lang, chunk, unnest({BUCKETS_SQL}) AS b FROM chunked) GROUP BY ALL),
    q AS (SELECT b, n FROM v WHERE (doc_id, chunk) = (SELECT (doc_id, chunk) FROM chunked WHERE lang = 'en' ORDER BY doc_id, chunk LIMIT 1)),
    s AS (SELECT doc_id, chunk, round(coalesce(sum(v.n * q.n), 0) / sqrt(sum(v.n * v.n)) / (SELECT sqrt(sum(n * n)) FROM q), 12) AS s FROM v LEFT JOIN q USING (b) GROUP BY doc_id, chunk),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, chunk) AS r FROM s WHERE s IS NOT NULL AND NOT isnan(s))
    SELECT doc_id, chunk, round(s, 4) AS score FROM best WHERE r = 1 ORDER BY s DESC, doc_id LIMIT 10"""
)
def chunk_topk(spark, sf_dir):
    """Builds an index of all chunks, and finds in it the ten documents with the chunk nearest to the first English chunk, each once."""
    folder = f"{record_store.shared_folder(spark)}/chunked-{uuid.uuid4().hex}"
    record_store.build_index(chunks(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), folder, "chunk_text", partition="lang")
    vectors = record_store.load_index(spark, folder)
    first = vectors.where("lang = 'en'").orderBy("doc_id", "chunk").select("embedding").first()
    scored = vectors.select("doc_id", "chunk", F.round(retrieval.cosine_batches(F.col("embedding"), list(first[0])), retrieval.RANK_DIGITS).alias("score"))
    return best_of_chunks(scored, "doc_id", 10).withColumn("score", F.round("score", 4))


#: A vector as a file: each number is the sample of a whole frame; odd ids have a silent second channel.
LOUD, RATE = 0.15, 1000
FRAME = RATE * speech.FRAME_MS // 1000


@query(
    f"""WITH f AS (SELECT vec_id, i - 1 AS i, CASE WHEN vec_id % 2 = 1 THEN x / 2 ELSE x END AS x, len(embedding) * {speech.FRAME_MS} AS ms FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i, trunc(unnest(embedding)::DOUBLE * 32767) / 32768 AS x FROM embeddings)),
    g AS (SELECT *, coalesce((i - lag(i) OVER p - 1) * {speech.FRAME_MS} >= {speech.SILENCE_MS}, true)::INT AS fresh FROM f WHERE x * x >= {LOUD * LOUD!r}::DOUBLE WINDOW p AS (PARTITION BY vec_id ORDER BY i)),
    h AS (SELECT vec_id, ms, segment, min(i) AS a, max(i) AS z FROM (SELECT *, sum(fresh) OVER (PARTITION BY vec_id ORDER BY i) - 1 AS segment FROM g) GROUP BY ALL),
    k AS (SELECT *, (a - lag(z) OVER p - 1) * {speech.FRAME_MS} // 2 AS l, (lead(a) OVER p - z - 1) * {speech.FRAME_MS} // 2 AS r FROM h WINDOW p AS (PARTITION BY vec_id ORDER BY segment))
    SELECT vec_id, CAST(segment AS INTEGER) AS segment, CAST(greatest(0, a * {speech.FRAME_MS} - least({speech.PAD_MS}, coalesce(l, {speech.PAD_MS}))) AS BIGINT) AS start_ms,
    CAST(least(ms, (z + 1) * {speech.FRAME_MS} + least({speech.PAD_MS}, coalesce(r, {speech.PAD_MS}))) AS BIGINT) AS end_ms FROM k"""
)
def wav_segments(spark, sf_dir):
    """Writes a WAV file for each vector, reads them back, and returns the segments between silences."""
    folder = f"{record_store.shared_folder(spark)}/audio-{uuid.uuid4().hex}"
    frames = lambda x: F.array_repeat((x.cast("double") * 32767).cast("int").cast("smallint"), FRAME)
    mono, odd = F.flatten(F.transform("embedding", frames)), F.col("vec_id") % 2 == 1
    samples = F.when(odd, F.flatten(F.transform(mono, lambda s: F.array(s, F.lit(0).cast("smallint"))))).otherwise(mono)
    wav_source.write_wavs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("name"), F.lit(RATE).alias("rate"), F.when(odd, 2).otherwise(1).alias("channels"), samples.alias("samples")), folder)
    files = wav_source.read_wavs(spark, folder).where("corrupt is null")
    own = files.select(F.regexp_extract("source_file", r"(\d+)\.wav$", 1).cast("bigint").alias("vec_id"), F.posexplode(speech.segments(F.col("levels"), F.col("n_samples") * 1000 / F.col("rate"), LOUD)).alias("segment", "s"))
    return own.select("vec_id", "segment", "s.*")


@query(TOML_SQL)
def toml_data_source_scan(spark, sf_dir):
    """The catalogue of toml_ingest by spark.read.format("toml"), without broken files and those that name no model."""
    toml_data_source.register(spark)
    rows = spark.read.format("toml").load(part_catalogue(spark, sf_dir))
    return car_documents(rows.where(F.col("corrupt").isNull() & truthy("car_model")))
