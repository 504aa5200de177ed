"""Speech data around the external models: samples, durations, audio payloads, voices, control messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions.semantics import let

#: Silence that separates segments, what is added at both sides, length of a frame, and the root of a frame's mean square that counts as speech.
SILENCE_MS, PAD_MS, FRAME_MS, THRESHOLD = 300, 200, 30, 0.02


def pcm_to_float(samples: Column) -> Column:
    """16-bit samples as -1 to 1."""
    return F.transform(samples, lambda x: x / 32768.0)


def downmixed(left: Column, right: Column) -> Column:
    """Mean of two channels."""
    return F.zip_with(left, right, lambda a, b: (a + b) / 2.0)


def confidence(no_speech: Column) -> Column:
    return 1 - F.coalesce(no_speech, F.lit(0.0))


def duration_ms(text: Column) -> Column:
    """Estimate from five characters a second."""
    return F.length(text) / 5 * 1000


def audio_payload(audio: Column) -> list[Column]:
    """Base64 text and size in bytes."""
    return [F.replace(F.base64(audio), F.lit("\r\n"), F.lit("")).alias("audio_base64"), F.octet_length(audio).alias("audio_bytes")]


def voices_of(locale: Column, language: str) -> Column:
    return locale.startswith(language) if language else F.lit(True)


def control_reply(payload: Column) -> Column:
    """ping: pong; end_session: stop; another type: itself; anything else: error."""
    kind = F.get_json_object(payload, "$.type")
    return F.when(kind == "ping", "pong").when(kind == "end_session", "stop").otherwise(F.coalesce(kind, F.lit("error")))


def segments(levels: Column, duration_ms: Column, threshold: float = THRESHOLD, silence_ms: int = SILENCE_MS, pad_ms: int = PAD_MS, frame_ms: int = FRAME_MS) -> Column:
    """array<struct<start_ms, end_ms>> of the stretches of loud frames between silences of silence_ms or more.

    levels are the frames' mean squares, null where there is none. Each side is padded, by half of a silence that is shorter
    than two pads, and within the duration. Without loud frames the array is empty; null levels give null.
    """
    apart = lambda a, b: F.coalesce((b - a - 1) * frame_ms >= silence_ms, F.lit(True))
    at = lambda xs, i: F.get(xs, i)
    half = lambda a, b: F.coalesce(F.least(F.lit(pad_ms), F.floor((b - a - 1) * frame_ms / 2).cast("int")), F.lit(pad_ms))

    def bounds(loud: Column) -> Column:
        firsts = F.filter(loud, lambda f, i: apart(at(loud, i - 1), f))
        lasts = F.filter(loud, lambda f, i: apart(f, at(loud, i + 1)))
        return let(F.struct(firsts.alias("f"), lasts.alias("l")), padded)

    def padded(own: Column) -> Column:
        first, last = own["f"], own["l"]
        start = lambda f, i: F.greatest(F.lit(0), f * frame_ms - half(at(last, i - 1), f))
        end = lambda i: F.least(duration_ms, (at(last, i) + 1) * frame_ms + half(at(last, i), at(first, i + 1)))
        return F.transform(first, lambda f, i: F.struct(start(f, i).cast("bigint").alias("start_ms"), end(i).cast("bigint").alias("end_ms")))

    return let(F.array_compact(F.transform(levels, lambda x, i: F.when(x >= threshold * threshold, i))), bounds)
