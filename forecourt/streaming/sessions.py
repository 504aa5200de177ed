"""Structured Streaming twins: turn buffers and session state by key, and running metrics."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from forecourt.sources.record_store import shared_folder

#: What a batch of a stream reads at most, about; a session's rows of one batch are sorted in memory.
BATCH = 64 << 20
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(rows: Iterator[pd.DataFrame], order: str, *columns: str) -> list[tuple]:
    """A batch's rows of one key as plain tuples, sorted. How many there are at most is bounded by the stream's read limit."""
    return sorted((x for part in rows for x in zip(part[order], *(part[c] for c in columns), strict=True)), key=lambda x: x[0])


class TurnBuffer(StatefulProcessor):
    """Collects frame sizes of a session until an end mark; then emits one turn, or none for an empty buffer.

    `end_session` clears the state. The state is two numbers and a counter, not the frames.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("buffer", "turn bigint, n bigint, size double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn, n, size = self.state.get() if self.state.exists() else (0, 0, 0.0)
        out, over = [], False
        for _, kind, frame in in_order(rows, "seq", "kind", "size"):
            if kind == "end_session":
                turn, n, size, over = 0, 0, 0.0, True
            elif kind == "end_turn":
                if n:
                    out.append((key[0], turn, n, size))
                turn, n, size, over = turn + 1, 0, 0.0, False
            else:
                n, size, over = n + 1, size + frame, False
        if over:
            self.state.clear()
        else:
            self.state.update((turn, n, size))
        yield pd.DataFrame(out, columns=["session", "turn_id", "n_frames", "total_size"])

    def close(self) -> None:
        pass


class TurnEvents(TurnBuffer):
    """As TurnBuffer, but a closed turn gives what a client is sent: transcription, response, and the start of speech."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for turns in super().handleInputRows(key, rows, timerValues):
            out = [(t.session, t.turn_id, i, event, t.n_frames) for t in turns.itertuples() for i, event in enumerate(("transcription", "response", "tts_start"))]
            yield pd.DataFrame(out, columns=["session", "turn_id", "step", "event", "n_frames"])


class ChatState(StatefulProcessor):
    """A session's state: its stage and the facts known so far. A turn is heard by its entry stage and goes at most a step on.

    rules has, for each transition, which bits of a turn's facts count, how many are needed, and from which stage on
    they are heard (as in funnel.session_stages). `end_session` emits the last state and clears it.
    """

    def __init__(self, rules: list[tuple[int, int, int]]):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("chat", "stage int, previous int, facts bigint, turns bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, previous, facts, turns = self.state.get() if self.state.exists() else (0, 0, 0, 0)
        ended = False
        for _, kind, own in in_order(rows, "seq", "kind", "facts"):
            if kind == "end_session":
                ended = True
                continue
            if ended:
                stage, previous, facts, turns, ended = 0, 0, 0, 0, False
            for mask, _, opened in self.rules:
                if stage >= opened:
                    facts |= int(own) & mask
            previous, turns = stage, turns + 1
            if stage < len(self.rules):
                mask, least, _ = self.rules[stage]
                stage += (facts & mask).bit_count() >= least
        if ended:
            self.state.clear()
        else:
            self.state.update((stage, previous, facts, turns))
        yield pd.DataFrame({"session": [key[0]], "stage": [stage], "previous": [previous], "turns": [turns], "ended": [ended]})

    def close(self) -> None:
        pass


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder as a stream of its files, about BATCH of them at a time."""
    path = f"{folder}/{name}.parquet"
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxBytesPerTrigger", BATCH)
    if found.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(found).isDirectory():
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)  # a stream reads folders only


def start(df: DataFrame, mode: str, folder: str, every: str | None = None):
    """Starts the stream into folder: polling at the given interval ("5 seconds"), or once over what is there."""
    def save(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(save)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def run_available(df: DataFrame, mode: str) -> DataFrame:
    """Processes what is there and returns the rows that the sink received, from the shared folder."""
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    query = start(df, mode, folder)
    query.awaitTermination()
    kept = spark.read.schema(StructType([*df.schema.fields, StructField("epoch", LongType())])).parquet(f"{folder}/out/*")
    return kept


def latest(rows: DataFrame, key: str) -> DataFrame:
    """Of update rows, the last of each key."""
    rest = [c for c in rows.columns if c not in (key, "epoch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(key, "x.*")


def state_by_key(df: DataFrame, key: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store that transformWithState works with
    return df.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Update", timeMode="None")
