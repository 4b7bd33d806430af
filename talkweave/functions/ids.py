"""Identifiers of utterances, files and channels. Nulls give nulls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATIONS = ("KITCHEN", "DINING", "LIVING", "NOLOCATION")


def zero_filled(number: Column, width: int) -> Column:
    """Decimal digits with leading zeros, never cut."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def centiseconds(samples: Column) -> Column:
    return F.call_function("div", samples, F.lit(160).cast("bigint"))


def example_id(speaker: Column, session: Column, start: Column, end: Column, single_clock: bool = False) -> Column:
    """``P09_S03_0287272-0287421``, or with ``-`` before the first time for single-clock corpora."""
    return F.concat(speaker, F.lit("_"), session, F.lit("-" if single_clock else "_"), zero_filled(centiseconds(start), 7), F.lit("-"), zero_filled(centiseconds(end), 7))


def diarised_id(file: Column, speaker: Column, start: Column, end: Column) -> Column:
    """``S02_U06.-1-000000100_000000200``: times in samples."""
    return F.concat(file, F.lit("_U06.-"), speaker, F.lit("-"), zero_filled(start, 9), F.lit("_"), zero_filled(end, 9))


def located_id(example: Column, location: Column) -> Column:
    """Puts ``LOCATION.L-`` (``NOLOCATION.L-`` for a null one) before the times."""
    part = F.split(example, "_")
    place = F.concat(F.coalesce(F.upper(location), F.lit("NOLOCATION")), F.lit(".L-"))
    return F.concat(F.array_join(F.slice(part, 1, F.size(part) - 1), "_"), F.lit("_"), place, F.element_at(part, -1))


def plain_id(example: Column) -> Column:
    """An id without location and channel; ids of four parts raise."""
    part = F.split(example, "_")
    last = F.element_at(part, -1)
    return F.when(F.size(part) == 4, F.raise_error(F.concat(F.lit("four parts: "), example)).cast("string")).otherwise(
        F.concat(F.element_at(part, 1), F.lit("_"), F.element_at(part, 2), F.lit("_"), F.regexp_replace(last, r"^[A-Z]+\.[A-Z0-9]+-", ""))
    )


def id_parts(example: Column) -> Column:
    """struct<speaker, session, array, location, channel, array_id_or_speaker>.

    ``array`` is the speaker, as consumers of that field expect; the last field is the array where the id names one.
    """
    speaker, session = F.regexp_extract(example, r"^(P\d+)", 1), F.regexp_extract(example, r"(S\d+)", 1)
    unit = F.regexp_extract(example, r"_(U\d+)", 1)
    return F.struct(
        speaker.alias("speaker"), session.alias("session"), speaker.alias("array"),
        F.nullif(F.regexp_extract(example, r"_([A-Z]+)\.", 1), F.lit("")).alias("location"),
        F.nullif(F.regexp_extract(example, r"\.([A-Z]+\d*)-", 1), F.lit("")).alias("channel"),
        F.when(unit == "", speaker).otherwise(unit).alias("array_id_or_speaker"),
    )


def channel_of(example: Column) -> Column:
    """The channel of an id, e.g. ``CH1`` or ``L``; null if it names none."""
    return id_parts(example)["channel"]


def file_id(name: Column) -> Column:
    """A diarisation file's name without ``_U06`` and ``.ENH``."""
    return F.replace(F.replace(name, F.lit("_U06"), F.lit("")), F.lit(".ENH"), F.lit(""))
