"""The staged funnel: allowed transitions, the next stage, and whole sessions without per-session loops."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.semantics import all_of, any_of, count_of, truthy
from forecourt.functions.vocabulary import EDGES, STAGES

PROFILE = ["name", "age", "target_driver", "family_size"]
NEEDS = ["prize", "brand", "powertrain_type", "vehicle_category_bottom", "design_style", "seat_layout"]
PLACE = ["reservation_date", "reservation_time", "reservation_location"]
CONTACT = ["test_driver", "reservation_phone_number"]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(EDGES, "stage string, next_stage string")


def stage_index(stage: Column) -> Column:
    """0-based place in the funnel; null for an unknown stage."""
    place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), stage)
    return F.when(place > 0, place.cast("int") - 1)


def next_stage(stage: Column, profile: list[Column], needs: list[Column], has_cars: Column, place: list[Column], contact: list[Column]) -> Column:
    """At most one step forward: any profile fact, two needs, a car, the whole place, place and contact."""
    located = all_of([truthy(c) for c in place])
    gates = [F.lit(True), any_of([truthy(c) for c in profile]), count_of([truthy(c) for c in needs]) >= 2, has_cars, located, located & all_of([truthy(c) for c in contact])]
    steps = [((stage == STAGES[i]) & gate, STAGES[i + 1]) for i, gate in enumerate(gates)]
    return reduce(lambda e, s: e.when(*s), steps[1:], F.when(*steps[0])).otherwise(stage)


def fact_bits(gates: list[tuple[list[Column], int, int]]) -> tuple[Column, list[tuple[int, int, int]]]:
    """A turn's facts as the bits of a number, and for each transition its bits, how many of them it needs, and from which stage on they are heard."""
    facts = [fact for conditions, *_ in gates for fact in conditions]
    bits = reduce(lambda a, b: a + b, [F.coalesce(f.cast("bigint"), F.lit(0)) * (1 << i) for i, f in enumerate(facts)], F.lit(0).cast("bigint"))
    places = [len(conditions) for conditions, *_ in gates]
    return bits, [(((1 << n) - 1) << sum(places[:k]), gates[k][1], gates[k][2]) for k, n in enumerate(places)]


def session_stages(turns: DataFrame, session: str, turn: str, gates: list[tuple[list[Column], int, int]]) -> DataFrame:
    """(session, stage) after all turns of each session, in one shuffle of the turns.

    gates has, for each transition, conditions on a turn's own facts, how many of them must have held on some turn
    so far, and the transition whose turn opens the collection of these facts (0: from the start). Each turn becomes a
    number whose bits are its facts. Tasks sort their sessions' turns and walk through them, in Arrow batches that need
    not end with a session; nothing but the state of one session is held.
    """
    bits, rules = fact_bits(gates)
    kind = turns.schema[session].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, stage, known = None, 0, 0
        started = False
        for batch in batches:
            keys, stages = [], []
            for key, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not started or key != last:
                    if started:
                        keys.append(last)
                        stages.append(stage)
                    last, stage, known, started = key, 0, 0, True
                for mask, _, opened in rules:
                    if stage >= opened:  # facts of a later stage aren't heard before it
                        known |= own & mask
                if stage < len(rules):
                    mask, least, _ = rules[stage]
                    stage += (known & mask).bit_count() >= least
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(stages, pa.int32())], names=["session", "k"])
        if started:
            yield pa.RecordBatch.from_arrays([pa.array([last], batch.schema.field(0).type), pa.array([stage], pa.int32())], names=["session", "k"])

    ordered = turns.select(F.col(session).alias("session"), F.col(turn).alias("turn"), bits.alias("bits")).repartition("session").sortWithinPartitions("session", "turn")
    found = ordered.select("session", "bits").mapInArrow(run, f"session {kind}, k int")
    return found.select(F.col("session").alias(session), F.get(F.array(*map(F.lit, STAGES)), F.col("k")).alias("stage"))
