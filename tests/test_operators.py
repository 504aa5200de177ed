"""Truth tables and edge cases of the operators."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.functions.semantics import filled, strip, truthy
from forecourt.functions.vocabulary import PROFILE_FIELDS, STAGES
from forecourt.operators import agent, catalogue, evaluation, extraction, funnel, records, retrieval, sequence
from forecourt.plans import registry
from forecourt.sources import record_store
from forecourt.sources.record_store import read_records
from forecourt.sources.toml_source import read_catalogue, write_catalogue


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def test_presence(spark):
    rows = spark.createDataFrame([(None,), ("",), (" ",), ("　\n",), (" a ",)], "x string").select(truthy("x"), filled("x"), strip("x")).collect()
    assert [tuple(r) for r in rows] == [(False, False, None), (False, False, ""), (True, False, ""), (True, False, ""), (True, True, "a")]


FSM = [
    ("welcome", {}, "profile_analysis"),
    ("profile_analysis", {"name": "A", "age": "30"}, "needs_analysis"),
    ("needs_analysis", {"brand": "B", "powertrain_type": "E"}, "car_selection_confirmation"),
    ("car_selection_confirmation", {"cars": "1"}, "reservation4s"),
    ("reservation4s", {"reservation_date": "d", "reservation_time": "t", "reservation_location": "l"}, "reservation_confirmation"),
    ("reservation_confirmation", {"reservation_date": "d", "reservation_time": "t", "reservation_location": "l", "test_driver": "x", "reservation_phone_number": "1"}, "farewell"),
    ("profile_analysis", {}, "profile_analysis"),
    ("needs_analysis", {"brand": "B"}, "needs_analysis"),
    ("car_selection_confirmation", {}, "car_selection_confirmation"),
    ("reservation4s", {"reservation_date": "d"}, "reservation4s"),
    ("reservation_confirmation", {"reservation_date": "d", "reservation_time": "t", "reservation_location": "l", "test_driver": "x"}, "reservation_confirmation"),
    ("farewell", {"name": "A", "brand": "B", "prize": "1", "cars": "1"}, "farewell"),
    ("profile_analysis", {"age": "30"}, "needs_analysis"),
    ("needs_analysis", {"prize": "1", "brand": "B"}, "car_selection_confirmation"),
    ("reservation4s", {"reservation_date": "d", "reservation_time": "t"}, "reservation4s"),
    ("profile_analysis", {"family_size": "3"}, "needs_analysis"),
    ("needs_analysis", {"brand": " ", "prize": " "}, "car_selection_confirmation"),
]


def test_next_stage(spark):
    fields = [*funnel.PROFILE, *funnel.NEEDS, *funnel.PLACE, *funnel.CONTACT, "cars"]
    df = spark.createDataFrame([(i, s, *(facts.get(f) for f in fields)) for i, (s, facts, _) in enumerate(FSM)], f"i int, stage string, {', '.join(f'{f} string' for f in fields)}")
    cols = lambda names: [F.col(n) for n in names]
    nxt = funnel.next_stage(F.col("stage"), cols(funnel.PROFILE), cols(funnel.NEEDS), truthy("cars"), cols(funnel.PLACE), cols(funnel.CONTACT))
    assert [r[0] for r in df.orderBy("i").select(nxt).collect()] == [x for *_, x in FSM]


def test_edges_are_a_superset_of_steps(spark):
    steps = {(a, b) for a, b in zip(STAGES, STAGES[1:], strict=False)}
    found = {tuple(r) for r in funnel.edges(spark).collect()}
    assert steps <= found and len(found) == 8


@pytest.mark.parametrize(
    ("text", "expected"),
    [('{"a": "1"}', {"a": "1"}), ('x ```json\n{"a": 2}\n``` y', {"a": "2"}), ('```\n{"a": "b"}```', {"a": "b"}), ("", None), ("no", None), ("{broken", None), ('  {"a": {"b": 1}} ', {"a": '{"b":1}'})],
)
def test_payload(spark, text, expected):
    assert one(spark, x=extraction.payload(F.lit(text)))["x"] == expected


def test_catalogue_in_the_order_of_paths(spark, tmp_path):
    for name in ("b", "a", "c"):
        (tmp_path / f"{name}.toml").write_text(f'car_model = "{name}"\n')
    assert [r["car_model"] for r in read_catalogue(spark, str(tmp_path), ordered=True).collect()] == ["a", "b", "c"]


def test_merge_keeps_old_for_blank_and_ignores_unknown(spark):
    df = spark.createDataFrame([("old", "", {"name": " ", "age": " 5 ", "other": "x"}), ("old", "1", None)], "name string, age string, answer map<string,string>")
    assert [tuple(r) for r in extraction.merge(df, "answer", ["name", "age"]).select("name", "age").collect()] == [("old", "5"), ("old", "1")]


def test_missing_fields_complete(spark):
    df = spark.range(1).select(*(F.lit("x").alias(f) for f in PROFILE_FIELDS))
    assert df.select(extraction.missing_fields(PROFILE_FIELDS, "None (profile complete)")).first()[0] == "None (profile complete)"


def test_filters(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "brand string, size string")
    assert retrieval.metadata_filter(df, {"brand": "a", "size": "x"}).count() == 1
    assert retrieval.metadata_filter(df, {"brand": "", "colour": "red"}).count() == 3
    assert retrieval.metadata_filter(df, {}).count() == 3


def test_results_text(spark):
    cars = F.array(F.struct(F.lit("A").alias("car_model"), F.lit(0.5).alias("score"), F.lit("s" * 400).alias("text_snippet")))
    assert one(spark, x=retrieval.matched_cars_text(cars))["x"] == f"1. A (relevance: 0.5)\n   {'s' * 200}"
    assert one(spark, x=retrieval.matched_cars_text(F.expr("cast(array() as array<struct<car_model: string, score: double, text_snippet: string>>)")))["x"] == "No vehicles matched yet."


def test_ratios(spark):
    r = one(spark, x=F.struct(*evaluation.precision_recall_f1(F.lit(0), F.lit(0), F.lit(0))), y=F.struct(*evaluation.precision_recall_f1(F.lit(0), F.lit(2), F.lit(3))))
    assert tuple(r["x"]) == (1.0, 1.0, 1.0) and tuple(r["y"]) == (0.0, 0.0, 0.0)


def test_order_statistics_of_ties_and_small_groups(spark):
    values = {"a": [1.0] * 100 + [2.0] * 5, "b": [3.0], "c": [float(i % 37) for i in range(1000)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs] + [("d", None)], "g string, v double")
    got = {r["g"]: (r["p95"], r["p50"]) for r in evaluation.order_statistics(df, "g", "v", {"p95": 0.95, "p50": 0.5}).collect()}
    expected = {g: tuple(sorted(vs)[min(int(len(vs) * q), len(vs) - 1)] for q in (0.95, 0.5)) for g, vs in values.items()}
    assert got == expected


def test_task_completion_can_be_negative_without_stages(spark):
    none = [F.lit("")] * 5
    r = one(spark, x=evaluation.task_completion(F.lit("needs_analysis"), F.lit(False), F.lit(None).cast("int"), none, none, none[:4]))
    assert r["x"] == pytest.approx(5.0)  # -15 for the stage, 20 for a reservation that isn't expected


def test_history_and_turns(spark):
    t = spark.createDataFrame([(1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 3, "system", "c"), (2, 1, "user", None)], "s int, t int, role string, text string")
    assert {r["s"]: r["history"] for r in sequence.history(t, "s", "t", "role", "text").collect()} == {1: "User: a\nAssistant: b", 2: "User: "}
    frames = spark.createDataFrame([(1, i, k, 1.0) for i, k in enumerate(["end", "f", "f", "end", "end", "f"])], "s int, i int, k string, v double")
    assert [tuple(r) for r in sequence.closed_turns(frames, "s", ["i"], F.col("k") == "end", F.col("v")).collect()] == [(1, 1, 2, 2.0)]


def test_upsert_and_status(spark):
    now = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "", "z"), (3, "n", "m")], "k int, x string, y string")
    assert sorted(tuple(r) for r in records.upsert(now, new, "k").collect()) == [(1, "a", "z"), (2, "c", "d"), (3, "n", "m")]
    asked = spark.createDataFrame([(1, "create"), (9, "create"), (9, "read"), (1, "read"), (None, "read")], "k int, m string")
    assert sorted((r["k"] or 0, r["m"], r["status"]) for r in records.request_status(asked, now, "k", "m").collect()) == [(0, "read", 400), (1, "create", 409), (1, "read", 200), (9, "create", 200), (9, "read", 404)]


def test_template_lines(spark):
    text = '# note\ntitle = "T"\n[A]\n# x\nbrand = "b"\nbrand_comments = ""\n[B]\nsize = "s"'
    rows = one(spark, x=catalogue.template_lines(F.lit(text)))["x"]
    assert [tuple(r) for r in rows] == [("", "title", "T"), ("A", "brand", "b"), ("A", "brand_comments", ""), ("B", "size", "s")]


def test_catalogue_files(spark, tmp_path):
    assert read_catalogue(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.toml").write_text('car_model = "M"\n[PriciseLabels]\nbrand = "B"\n')
    (tmp_path / "nameless.toml").write_text('title = "x"\n')
    (tmp_path / "bad.toml").write_text("= x")
    (tmp_path / "CarLabels.toml").write_text('car_model = "template"\n')
    assert [r["car_model"] for r in read_catalogue(spark, str(tmp_path)).collect()] == ["M"]
    assert read_catalogue(spark, str(tmp_path), permissive=True).where("corrupt is not null").count() == 1


def test_records_of_both_shapes(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"phone_number": "1", "car_model": "M", "reservation": {"test_driver": "A"}}')
    (tmp_path / "2.json").write_text('{"test_drive_info": {"test_driver": "B", "brand": "X", "selected_car_model": "N", "status": "open"}}')
    (tmp_path / "3.json").write_text("{not json")
    assert sorted((r["key"], r["test_driver"], r["car_model"], r["status"]) for r in read_records(spark, str(tmp_path)).collect()) == [("1", "A", "M", ""), ("2", "B", "N", "open")]


def test_batch_search_takes_queries_of_any_number(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (600, 3)).astype(float)  # many equal scores, and zero vectors
    x[5] = 0
    rows = [(i, v) for i, v in enumerate(x.tolist())] + [(600, None)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    unit = np.array([v / (np.linalg.norm(v) or 1) for v in x])
    bad = np.flatnonzero(~x.any(axis=1))
    expected = []
    for q in range(0, 600, 2):
        score = np.round(unit @ unit[q], 12)
        score[bad] = -2
        if q in bad:
            score[:] = -2
        order = sorted(range(600), key=lambda i: (-score[i], i))[:5]
        expected += [(q, i, None if score[i] == -2 else float(score[i]), r + 1) for r, i in enumerate(order)]
    for size in (32_768, 128):
        monkeypatch.setattr(retrieval, "GROUP", size)
        monkeypatch.setattr(retrieval, "TILE", size)
        found = retrieval.top_k_batch(df, df.where("vec_id % 2 = 0 and vec_id < 600"), 5).collect()
        assert sorted(map(tuple, found)) == sorted(expected)
    many = spark.range(200_020).selectExpr("id as vec_id", "array(cast(1 as double), cast(id as double)) as embedding")
    assert retrieval.top_k_batch(many.where("vec_id < 5"), many.where("vec_id % 20 = 0"), 1).count() == 10_001  # more than 10,000 were refused


def test_catalogue_of_all_parts(spark):
    folder = "/root/testdata/sf0.001"
    entry = lambda section, i, key, value: F.struct(F.lit(section).alias("section"), F.lit(i).alias("ord"), F.lit(key).alias("key"), value.alias("value"))
    entries = F.array(entry("PriciseLabels", 0, "brand", F.col("p_brand")), entry("PriciseLabels", 1, "brand_comments", F.expr("'A ' || p_type || ' car'")), entry("AmbiguousLabels", 0, "size", F.col("p_size").cast("string")))
    name = F.expr("p_brand || '-' || p_partkey")
    text = catalogue.document_text(name, F.col("p_name"), F.lit(None).cast("string"), entries)
    part = spark.read.parquet(f"{folder}/part.parquet")
    expected = part.select(name.alias("car_model"), text.alias("text"), F.size(catalogue.metadata(name, entries)).alias("n_fields"))
    found = registry.QUERIES["toml_ingest"](spark, folder).drop("n_filters")
    assert found.count() == part.count() > 20 and found.exceptAll(expected).count() == 0


def test_written_catalogue_reads_back(spark, tmp_path):
    odd = 'a "quoted" \\ back\nline\x7f\x01 é\u2028'
    rows = [("1", ("M", {"brand": odd})), ("2", ("N", {"brand": None}))]
    cars = spark.createDataFrame(rows, "name string, car struct<car_model: string, PriciseLabels: struct<brand: string>>")
    assert write_catalogue(cars, tmp_path.as_uri()) == 2
    found = {r["car_model"]: [e["value"] for e in r["entries"]] for r in read_catalogue(spark, str(tmp_path)).collect()}
    assert found == {"M": [odd], "N": []}


def test_latency_report_collects_no_group(spark):
    df = spark.createDataFrame([("even", float(x)) for x in (4, 1, 3, 2)] + [("odd", float(x)) for x in (9, 7, 8)] + [("one", 5.0), ("none", None)], "g string, v double")
    report = evaluation.latency_report(df, "g", "v")
    assert {r["g"]: r["p50_ms"] for r in report.collect()} == {"even": 2.5, "odd": 8.0, "one": 5.0, "none": 0.0}
    assert not re.search(r"\b(percentile|median)\(", report._jdf.queryExecution().toString())


def test_near_scores_rank_by_the_raw_score(spark):
    """Scores that agree to four digits aren't ties; presentation rounds them."""
    rows = [(1, [1.0, 0.0031]), (2, [1.0, 0.003]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0]), (7, [1.0, None])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    found = retrieval.top_k(df, [1.0, 0.0], 7)
    assert [r["vec_id"] for r in found.collect()] == [3, 2, 1, 4, 5, 6, 7]
    assert {r["vec_id"]: r["score"] for r in found.collect()}[4] is None
    batch = retrieval.top_k_batch(df.where("vec_id < 6"), df.where("vec_id = 3"), 3).orderBy("rank").collect()
    assert [r["vec_id"] for r in batch] == [3, 2, 1]
    assert [r["score"] for r in retrieval.format_results(found.where("vec_id < 3").withColumn("n", F.lit("A")), "n", "n").collect()] == [1.0, 1.0]


def test_several_changes_of_one_key(spark):
    now = spark.createDataFrame([(1, "a", "b")], "k int, x string, y string")
    new = spark.createDataFrame([(1, "p", "", 2), (1, "q", "z", 1), (1, "", None, 3), (2, "n", "", 1)], "k int, x string, y string, at int")
    assert sorted(tuple(r) for r in records.upsert(now, new, "k", "at").collect()) == [(1, "p", "z"), (2, "n", None)]
    assert records.upsert(now, new.drop("at"), "k").count() == 2


@pytest.mark.parametrize(
    ("answer", "expected"),
    [('{"x": false, "y": 0, "z": true}', ("old", "old", "True")), ('{"x": 0.0, "y": [], "z": {}}', ("old", "old", "old")), ('{"x": 7, "y": null, "z": " v "}', ("7", "old", "v")), ('{"x": 1.5, "y": [1], "z": "  "}', ("1.5", "[1]", "old")), ("nothing", ("old", "old", "old"))],
)
def test_values_that_count_as_empty_keep_the_old_one(spark, answer, expected):
    df = spark.createDataFrame([("old", "old", "old", answer)], "x string, y string, z string, a string")
    assert tuple(agent.extract(df, ["a"], ["x", "y", "z"]).drop("a").first()) == expected


def test_field_scores_count_expected_fields_only(spark):
    maps = lambda e, x: one(spark, s=evaluation.field_scores(F.create_map(*map(F.lit, e)), F.create_map(*map(F.lit, x))))["s"]
    assert tuple(maps(["name", "Ann", "age", "30", "city", ""], ["name", " ann ", "age", "31", "other", "x"])) == (1, 2, 2)
    assert tuple(maps(["name", "Ann"], ["name", ""])) == (0, 0, 1)


def test_report_text_marks_targets():
    text = evaluation.report_text({"overall": 70.5, "stage": 80}, {"stage": 90.0})
    assert "| overall | 70.5 |  |  |" in text and "| stage | 80 | 90.0 | no |" in text


def test_stores(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"phone_number": "1", "name": "A"}')
    (tmp_path / "2.json").write_text('{"connection_information": {"name": "B"}, "additional_information": {"age": "9"}}')
    (tmp_path / "3.json").write_text("{broken")
    rows = record_store.read_profiles(spark, str(tmp_path))
    assert sorted(r["key"] for r in record_store.keys_of(rows).collect()) == ["1", "2", "3"]
    asked = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "key string")
    assert sorted((r["key"], r["name"], r["age"]) for r in record_store.lookup(rows, asked).collect()) == [("1", "A", None), ("2", "B", "9"), ("3", None, None), ("9", None, None)]
    assert {r["key"]: r["state"] is not None for r in record_store.read_sessions(spark, str(tmp_path)).collect()} == {"1": True, "2": True, "3": False}


def test_an_empty_index_is_an_error(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a")], "doc_id int, text string")
    with pytest.raises(ValueError, match="no documents"):
        record_store.build_index(docs.where("false"), str(tmp_path / "x"), "text")
    record_store.build_index(docs, str(tmp_path / "i"), "text")
    assert sum(record_store.load_index(spark, str(tmp_path / "i")).first()["embedding"]) == 3
    record_store.write_snapshot(docs.where("false"), str(tmp_path / "e"))
    with pytest.raises(ValueError, match="is empty"):
        record_store.load_index(spark, str(tmp_path / "e"))


def test_numbers_in_order_over_many_partitions(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"))
    assert all(r["n"] == r["x"] + 1 for r in records.numbered(df.repartition(7), ["x"], "n").collect())


def test_turn_of_every_stage(spark):
    """A retrieval without results keeps the cars; in the older order it replaces them."""
    fields = agent.PROFILE_FIELDS + agent.EXPLICIT_FIELDS + agent.IMPLICIT_FIELDS + agent.RESERVATION_FIELDS
    df = spark.createDataFrame([("needs_analysis", ["old"], [], "{}", '{"explicit": {"brand": "b", "prize": "p"}}', "{}")], "stage string, matched_cars array<string>, retrieved_cars array<string>, p string, n string, r string")
    df = df.withColumns({f: F.lit("") for f in fields})
    now, before = (f(df, ["p"], "n", ["r"]).first() for f in (agent.process_turns, agent.process_turns_legacy))
    assert (now["stage"], now["previous_stage"], now["stage_changed"], now["matched_cars"]) == ("car_selection_confirmation", "needs_analysis", True, ["old"])
    assert (before["stage"], before["matched_cars"]) == ("car_selection_confirmation", [])


class Store:
    """A value state without Spark."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


def test_end_of_a_session_clears_its_state():
    import pandas as pd

    from forecourt.streaming.sessions import ChatState, TurnBuffer

    buffer = TurnBuffer()
    buffer.state = Store()
    frames = lambda *kinds: iter([pd.DataFrame({"seq": range(len(kinds)), "kind": kinds, "size": 1.0})])
    assert [len(x) for x in buffer.handleInputRows((1,), frames("bytes", "end_turn", "end_turn", "bytes"), None)] == [1]
    assert buffer.state.value == (2, 1, 1.0)
    assert [len(x) for x in buffer.handleInputRows((1,), frames("bytes", "end_session"), None)] == [0] and buffer.state.value is None
    chat = ChatState([(0, 0, 0), (1, 1, 0), (2, 1, 2)])
    chat.state = Store()
    turns = lambda *rows: iter([pd.DataFrame({"seq": range(len(rows)), "kind": [k for k, _ in rows], "facts": [f for _, f in rows]})])
    first = next(chat.handleInputRows((1,), turns(("message", 3), ("message", 0)), None)).iloc[0]
    assert (first.stage, first.turns) == (2, 2)  # the fact of the third step was told too early to be heard
    last = next(chat.handleInputRows((1,), turns(("message", 2), ("end_session", 0)), None)).iloc[0]
    assert (last.stage, last.previous, last.ended) == (3, 2, True) and chat.state.value is None


def test_a_stream_can_poll(spark, tmp_path):
    import time

    from forecourt.streaming import sessions

    spark.range(5).write.parquet(str(tmp_path / "in" / "a.parquet"))
    stream = spark.readStream.schema("id bigint").parquet(str(tmp_path / "in" / "*"))
    running = sessions.start(stream, "append", str(tmp_path / "out"), "1 seconds")
    try:
        running.processAllAvailable()
        spark.range(5, 8).write.parquet(str(tmp_path / "in" / "b.parquet"))
        time.sleep(1)
        running.processAllAvailable()
    finally:
        running.stop()
    assert spark.read.parquet(str(tmp_path / "out" / "out" / "*")).count() == 8


def test_kpi_report_of_few_and_of_no_rows(spark):
    maps = "extractor string, expected map<string,string>, extracted map<string,string>"
    extracted = spark.createDataFrame([("profile", {"a": "1", "b": "2"}, {"a": " 1 "}), ("needs", {"a": "x"}, {"a": "X"}), ("other", {"a": "x"}, {})], maps)
    turns = spark.createDataFrame([("welcome", "welcome"), ("farewell", "welcome"), ("farewell", None), ("welcome", "welcome")], "expected string, actual string")
    latencies = spark.createDataFrame([(float(x),) for x in range(100)] + [(None,)], "ms double")
    rows = evaluation.kpi_report(extracted, turns, latencies)
    found = {(r["section"], r["name"], r["metric"]): (r["value"], r["target"], r["met"]) for r in rows.collect()}
    assert len(found) == 3 * 3 + 3 + 5
    assert found["extraction", "profile", "precision"] == (1.0, None, None) and found["extraction", "profile", "recall"] == (0.5, None, None)
    assert found["extraction", "profile", "f1"] == (pytest.approx(2 / 3), 0.9, False) and found["extraction", "needs", "f1"] == (1.0, 0.85, True)
    assert found["extraction", "other", "f1"][1:] == (None, None)
    assert found["stages", "all", "accuracy"] == (0.5, 1.0, False) and found["stages", "all", "turns"][0] == 4
    assert found["latency", "all", "p50"] == (50.0, None, None) and found["latency", "all", "p95"] == (95.0, 50.0, False)
    assert found["latency", "all", "avg"] == (49.5, 10.0, False) and found["latency", "all", "samples"][0] == 100
    text = evaluation.kpi_text(rows, "2024-01-01")
    assert "## 1. Extraction accuracy" in text and "| needs | f1 | 1 | >= 0.85 | yes |" in text and "| all | p95 | 95 | < 50 | no |" in text
    none = evaluation.kpi_report(extracted.limit(0), turns.limit(0), latencies.limit(0)).collect()
    assert {(r["section"], r["metric"]): r["value"] for r in none} == {("stages", "accuracy"): None, ("stages", "right"): 0.0, ("stages", "turns"): 0.0}
