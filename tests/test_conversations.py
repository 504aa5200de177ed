"""Streams that keep whole sessions: restarts, stored sessions, ends, and expiry."""

import json
import time

import pytest
from pyspark.sql import functions as F

from forecourt.plans import stream_queries
from forecourt.streaming import conversations, sessions
from tests.oracle import duck, rows

TURNS = "session string, seq string, kind string, answers string, cars string, text string, response string"


def turn(session, seq, kind="message", cars=None, response="ok", **answers):
    return (session, f"{seq:03d}", kind, json.dumps(answers), cars and json.dumps(cars), "hello", response)


def put(spark, folder, found, schema):
    spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder, schema, through):
    stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
    sessions.start(through(stream), "update", str(folder)).awaitTermination()
    return spark.read.parquet(f"{folder}/out/*")


def test_a_restart_in_the_middle_changes_nothing(spark, tmp_path):
    """Turns of all conversations, an earlier and a later half in two runs with one checkpoint, equal the fold over whole ones."""
    sf = "/root/testdata/sf0.001"
    turns = stream_queries.conversation_turns(spark.read.parquet(f"{sf}/conversations.parquet"))
    for half in ("seq < '00000000000000000002'", "seq >= '00000000000000000002'"):
        turns.where(half).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = run(spark, tmp_path, turns.schema, conversations.conversations)
    assert found.select("epoch").distinct().count() == 2
    assert rows(stream_queries.conversation_rows(found).toPandas()) == rows(duck(stream_queries.CONVERSATION_SQL, sf))


def test_a_session_is_taken_up_ended_and_begun_again(spark, tmp_path):
    stored = spark.createDataFrame([("a", "needs_analysis", '{"name": "Lo"}', "[]", '[["user", "hi"]]')], "session string, stage string, fields string, cars string, messages string")
    put(spark, tmp_path, [
        turn("a", 1, explicit={"brand": " B ", "prize": "", "unknown": "x"}, profile={"name": "ignored"}),
        turn("a", 2, explicit={"prize": "low"}, cars=["c1"], response=None),
        turn("a", 3, cars=[]),
        turn("a", 4, kind="end_session"),
        turn("a", 5),
        turn("b", 1, profile={"name": "x"}),
    ], TURNS)
    found = run(spark, tmp_path, TURNS, lambda s: conversations.conversations(s, stored)).orderBy("session", "seq").collect()
    got = [(r["session"], r["previous_stage"], r["stage"], json.loads(r["fields"]), json.loads(r["cars"]), r["n_messages"], r["ended"]) for r in found]
    needs, cars, place = "needs_analysis", "car_selection_confirmation", "reservation4s"
    assert got == [
        ("a", needs, needs, {"name": "Lo", "brand": "B"}, [], 3, False),
        ("a", needs, cars, {"name": "Lo", "brand": "B", "prize": "low"}, ["c1"], 5, False),
        ("a", cars, place, {"name": "Lo", "brand": "B", "prize": "low"}, ["c1"], 7, False),
        ("a", place, place, {"name": "Lo", "brand": "B", "prize": "low"}, ["c1"], 7, True),
        ("a", "welcome", "profile_analysis", {}, [], 2, False),
        ("b", "welcome", "profile_analysis", {"name": "x"}, [], 2, False),
    ]
    assert found[1]["response"] == conversations.APOLOGY


def test_frames_wait_for_their_end(spark, tmp_path):
    schema = "session string, seq string, kind string, frame binary"
    through = lambda s: sessions.state_by_key(s, "session", conversations.TurnAudio(), "session string, turn_id bigint, n_frames bigint, audio binary")
    put(spark, tmp_path, [("a", "1", "bytes", b"\x00\x01"), ("a", "2", "bytes", b""), ("b", "1", "end_turn", None), ("c", "1", "bytes", b"x")], schema)
    assert run(spark, tmp_path, schema, through).count() == 0
    put(spark, tmp_path, [("a", "3", "bytes", b"\xff"), ("a", "4", "end_turn", None), ("a", "5", "bytes", b"z"), ("c", "2", "end_session", None), ("c", "3", "end_turn", None)], schema)
    assert [(r["session"], r["turn_id"], r["n_frames"], bytes(r["audio"])) for r in run(spark, tmp_path, schema, through).where("session is not null").collect()] == [("a", 0, 3, b"\x00\x01\xff")]
    put(spark, tmp_path, [("a", "6", "end_turn", None), ("a", "7", "end_turn", None)], schema)
    assert sorted((r["turn_id"], bytes(r["audio"])) for r in run(spark, tmp_path, schema, through).collect()) == [(0, b"\x00\x01\xff"), (1, b"z")]


def test_a_session_without_turns_expires(spark, tmp_path):
    schema = "session string, seq string, latency double, language string"
    put(spark, tmp_path, [("a", "1", 2.0, "en"), ("a", "2", 4.0, ""), ("a", "3", 3.0, "zh")], schema)
    stream = conversations.running_metrics(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), keep_ms=1500)
    query = sessions.start(stream, "update", str(tmp_path), "500 milliseconds")
    try:
        found = lambda: sorted((r["seq"] or "", r["turns"], r["total_ms"], r["avg_ms"], r["languages"], r["ended"]) for r in spark.read.parquet(f"{tmp_path}/out/*").collect())
        until = time.time() + 60
        while time.time() < until and query.isActive:
            if [*tmp_path.glob("out/*/*.parquet")] and any(x[-1] for x in found()):
                break
            time.sleep(1)
        assert found() == [("", 3, 9.0, 3.0, "en,zh", True), ("1", 1, 2.0, 2.0, "en", False), ("2", 2, 6.0, 3.0, "en", False), ("3", 3, 9.0, 3.0, "en,zh", False)]
        put(spark, tmp_path, [("a", "4", 8.0, "fr")], schema)
        until = time.time() + 60
        while time.time() < until and query.isActive and ("4", 1, 8.0, 8.0, "fr", False) not in found():
            time.sleep(1)
        assert ("4", 1, 8.0, 8.0, "fr", False) in found()  # nothing of the session was left
    finally:
        query.stop()


@pytest.mark.parametrize("size", ["1m", "64m"])
def test_numbers_of_wide_rows_are_whole(spark, size):
    """Every row once, with ids in order, whatever partitions an adaptive plan makes of each read."""
    from forecourt.operators import records

    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        wide = spark.read.parquet("/root/testdata/sf0.1/orders.parquet").select("o_orderkey", F.struct(F.repeat(F.md5(F.col("o_orderkey").cast("string")), 4).alias("notes"), F.col("o_orderdate").alias("_part")).alias("test_drive_info"))
        found = records.dealer_rows(wide, ["o_orderkey"])
        n, least, most, different, wrong = found.agg(F.count("*"), F.min("id"), F.max("id"), F.countDistinct("id"), F.sum((F.length("notes") != 128).cast("int"))).first()
        assert (n, least, most, different, wrong) == (150_000, 1, 150_000, 150_000, 0)
        assert [r["o_orderkey"] for r in found.orderBy("id").limit(500).collect()] == [r["o_orderkey"] for r in wide.orderBy("o_orderkey").limit(500).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_histories_within_a_limit(spark):
    from forecourt.operators import sequence

    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 4), ("b", 1, 11), ("c", 1, 10)], "s string, t int, n int")
    kept = lambda limit: sorted((r["s"], r["t"]) for r in sequence.latest_within(df, "s", ["t"], "n", limit).collect())
    assert kept(None) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1)]
    assert kept(8) == [("a", 2), ("a", 3)] and kept(10) == [("a", 1), ("a", 2), ("a", 3), ("c", 1)]
