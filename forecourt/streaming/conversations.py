"""Whole sessions as state of a stream: dialogues with all their fields, audio turns, and running metrics that expire."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from forecourt.functions.vocabulary import EXPLICIT_FIELDS, IMPLICIT_FIELDS, PROFILE_FIELDS, RESERVATION_FIELDS, STAGES
from forecourt.operators import funnel
from forecourt.streaming.sessions import ROCKS, in_order

#: What a reply is where none could be made.
APOLOGY = "Sorry, something went wrong. Could you say that again?"
#: How much longer than its timer a state lives at most.
GUARD_MS = 3_600_000
#: The parts of a turn's answers that are heard, by its entry stage, with their fields.
HEARD = [["profile"], ["profile"], ["explicit", "implicit"], ["explicit", "implicit"], ["reservation"], ["reservation"], []]
FIELDS = {"profile": PROFILE_FIELDS, "explicit": EXPLICIT_FIELDS, "implicit": IMPLICIT_FIELDS, "reservation": RESERVATION_FIELDS}

TURN = "session {key}, seq string, stage string, previous_stage string, stage_changed boolean, fields string, cars string, response string, n_messages bigint, ended boolean"


def answers_json(**parts: Column) -> Column:
    """A turn's answers (map<string,string> each, null where none could be read) as a text for Conversation."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in parts.items())))


class Conversation(StatefulProcessor):
    """A dialogue session: its fields, cars, messages, and stage. A row a turn comes out, with the state after it.

    A turn has seq, kind ("message" or "end_session"), answers (of answers_json), cars (a JSON list, or null), text and
    response. The entry stage decides which answers are heard; filled values win; new cars replace the old ones if there are any;
    then the session goes at most a step on, and both messages are appended. `end_session` leaves no state. Sessions
    that a store holds can be taken up: rows (session, stage, fields, cars, messages) as initial state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.stage = handle.getValueState("stage", "stage int, turns bigint")
        self.fields = handle.getMapState("fields", "name string", "value string")
        self.cars = handle.getListState("cars", "car string")
        self.messages = handle.getListState("messages", "role string, text string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for r in initialState.itertuples():
            self.stage.update((STAGES.index(r.stage), 0))
            for name, value in json.loads(r.fields or "{}").items():
                self.fields.updateValue((name,), (value,))
            if cars := json.loads(r.cars or "[]"):
                self.cars.put([(c,) for c in cars])
            if said := json.loads(r.messages or "[]"):
                self.messages.put([tuple(m) for m in said])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        stage, turns = self.stage.get() if self.stage.exists() else (0, 0)
        fields = {k[0]: v[0] for k, v in self.fields.iterator()}
        cars = [c[0] for c in self.cars.get()]
        n = sum(1 for _ in self.messages.get())
        out, live = [], self.stage.exists()
        for seq, kind, answers, found, text, response in in_order(rows, "seq", "kind", "answers", "cars", "text", "response"):
            if kind == "end_session":
                out.append((key[0], seq, STAGES[stage], STAGES[stage], False, json.dumps(fields, sort_keys=True), json.dumps(cars), None, n, True))
                for state in (self.stage, self.fields, self.cars, self.messages):
                    state.clear()
                stage, turns, fields, cars, n, live = 0, 0, {}, [], 0, False
                continue
            given = json.loads(answers) if answers else {}
            for part in HEARD[stage]:
                for name, value in (given.get(part) or {}).items():
                    if name in FIELDS[part] and isinstance(value, str) and value.strip():
                        fields[name] = value.strip()
                        self.fields.updateValue((name,), (fields[name],))
            if new := json.loads(found) if found else []:
                cars = new
                self.cars.put([(c,) for c in cars])
            before, stage = stage, stage + forward(stage, fields, cars)
            reply = response or APOLOGY
            self.messages.appendList([("user", text or ""), ("assistant", reply)])
            turns, n, live = turns + 1, n + 2, True
            out.append((key[0], seq, STAGES[stage], STAGES[before], stage != before, json.dumps(fields, sort_keys=True), json.dumps(cars), reply, n, False))
        if live:
            self.stage.update((stage, turns))
        yield pd.DataFrame(out, columns=["session", "seq", "stage", "previous_stage", "stage_changed", "fields", "cars", "response", "n_messages", "ended"])

    def close(self) -> None:
        pass


def forward(stage: int, fields: dict[str, str], cars: list) -> bool:
    """Whether a session goes a step on from this stage (as funnel.next_stage)."""
    known = lambda names: sum(bool(fields.get(x)) for x in names)
    place = known(funnel.PLACE) == len(funnel.PLACE)
    return bool([True, known(funnel.PROFILE) > 0, known(funnel.NEEDS) > 1, len(cars) > 0, place, place and known(funnel.CONTACT) == len(funnel.CONTACT), False][stage])


def conversations(turns: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """A stream's turns by session through Conversation; stored are sessions to take up."""
    spark = turns.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    initial = None if stored is None else stored.select("session", "stage", "fields", "cars", "messages").groupBy("session")
    schema = TURN.format(key=turns.schema["session"].dataType.simpleString())
    return turns.groupBy("session").transformWithStateInPandas(Conversation(), schema, "Update", "None", initial)


class TurnAudio(StatefulProcessor):
    """Keeps a session's binary frames until `end_turn`, which gives one row with all its bytes, or none for an empty buffer.

    `end_session` clears frames and counter. What is kept of a session is what its open turn has sent.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turn = handle.getValueState("turn", "turn bigint")
        self.frames = handle.getListState("frames", "frame binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turn = self.turn.get()[0] if self.turn.exists() else 0
        out, own, cleared = [], [], False
        for _, kind, frame in in_order(rows, "seq", "kind", "frame"):
            if kind == "end_session":
                turn, own, cleared = 0, [], True
            elif kind == "end_turn":
                whole = own if cleared else [bytes(x[0]) for x in self.frames.get()] + own
                if whole:
                    out.append((key[0], turn, len(whole), b"".join(whole)))
                turn, own, cleared = turn + 1, [], True
            elif frame is not None:
                own.append(bytes(frame))
        if cleared:
            self.frames.clear()
        if own:
            self.frames.appendList([(x,) for x in own])
        self.turn.update((turn,))
        yield pd.DataFrame(out, columns=["session", "turn_id", "n_frames", "audio"])

    def close(self) -> None:
        pass


class RunningMetrics(StatefulProcessor):
    """A row a turn: turns so far, total and mean latency, languages in the order of their first turn.

    With keep_ms the state of a session goes so long after its last turn: a timer then gives a last row with ended, and as a
    second guard the state lives GUARD_MS longer at most. Without it, it stays. Timers need a stream that goes on
    (processingTime): one over what is available would wait for them forever.
    """

    def __init__(self, keep_ms: int | None):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        live = self.keep_ms + GUARD_MS if self.keep_ms else None
        self.totals = handle.getValueState("totals", "turns bigint, total double, due bigint", live)
        self.languages = handle.getListState("languages", "language string", live)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns, total, due = self.totals.get() if self.totals.exists() else (0, 0.0, 0)
        languages, out = [x[0] for x in self.languages.get()], []
        for seq, latency, language in in_order(rows, "seq", "latency", "language"):
            turns, total = turns + 1, total + latency
            if language and language not in languages:
                languages.append(language)
            out.append((key[0], seq, turns, total, total / turns, ",".join(languages), False))
        if self.keep_ms:
            if due:
                self.handle.deleteTimer(due)
            due = timerValues.getCurrentProcessingTimeInMs() + self.keep_ms
            self.handle.registerTimer(due)
        self.totals.update((turns, total, due))
        self.languages.put([(x,) for x in languages])
        yield pd.DataFrame(out, columns=METRICS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.totals.exists():
            turns, total, _ = self.totals.get()
            out.append((key[0], None, turns, total, total / turns, ",".join(x[0] for x in self.languages.get()), True))
        self.totals.clear()
        self.languages.clear()
        yield pd.DataFrame(out, columns=METRICS)

    def close(self) -> None:
        pass


METRICS = ["session", "seq", "turns", "total_ms", "avg_ms", "languages", "ended"]


def running_metrics(turns: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """A stream's turns (session, seq, latency, language) through RunningMetrics."""
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    key = turns.schema["session"].dataType.simpleString()
    schema = f"session {key}, seq string, turns bigint, total_ms double, avg_ms double, languages string, ended boolean"
    return turns.groupBy("session").transformWithStateInPandas(RunningMetrics(keep_ms), schema, "Update", "ProcessingTime" if keep_ms else "None")
