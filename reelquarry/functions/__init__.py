"""Scalar functions on columns: song keys, stamps and lengths, names, codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRAME_SAMPLES = 16

#: Sample rates by code, and the one that unknown codes have. Fixed values of the format.
RATES, DEFAULT_RATE = {0: 48000, 1: 44100, 2: 32000, 3: 96000, 4: 88200}, 44100


def song_key(partition: Column, ordinal: Column) -> Column:
    """`ordinal` on a disc (partition 0), else `partition.ordinal`."""
    return F.when(partition == 0, ordinal.cast("string")).otherwise(F.concat_ws(".", partition.cast("string"), ordinal.cast("string")))


def folder_name(partition: Column, ordinal: Column) -> Column:
    return F.when(partition == 0, F.format_string("%02d", ordinal)).otherwise(F.format_string("%02d.%03d", partition, ordinal))


def parse_song_key(text: Column) -> Column:
    """struct<partition int, ordinal int> of a key's text, null if it is none."""
    t = F.trim(text)
    whole = F.expr("null").cast("int")
    number = lambda group, pattern: F.regexp_extract(t, pattern, group).try_cast("int")
    single, double = r"^\+?([0-9]+)$", r"^\+?([0-9]+)\.\+?([0-9]+)$"
    partition = F.when(t.rlike(single), F.lit(0)).when(t.rlike(double), number(1, double)).otherwise(whole)
    ordinal = F.when(t.rlike(single), number(1, single)).when(t.rlike(double), number(2, double)).otherwise(whole)
    good = partition.isNotNull() & ordinal.isNotNull() & (t.rlike(single) | (partition >= 1))
    return F.when(good, F.struct(partition.alias("partition"), ordinal.alias("ordinal")))


def stamp(bytes8: Column) -> Column:
    """Eight bytes second, minute, hour, weekday, day, month, year (big-endian) as TIMESTAMP_NTZ.

    Null if there are fewer bytes or the year is 0. The weekday is ignored; fields out of range carry over, as month 13
    is January of the next year.
    """
    at = lambda k, n=1: F.conv(F.hex(F.substring(bytes8, k + 1, n)), 16, 10).cast("int")
    year = at(6, 2)
    day = F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), at(5) - 1), at(4) - 1)
    whole = day.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), at(2), at(1), at(0).cast("decimal(18,6)"))
    return F.when((F.length(bytes8) >= 8) & (year > 0), whole)


def seconds(frames: Column, rate: Column) -> Column:
    """Whole seconds of a length in frames; 0 without a rate."""
    return F.when(rate > 0, F.floor(frames * FRAME_SAMPLES / F.when(rate > 0, rate))).otherwise(0).cast("long")


def mmss(whole_seconds: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(whole_seconds / 60).cast("long"), (whole_seconds % 60).cast("long"))


def stamp_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def trim_name(raw: Column) -> Column:
    """Without spaces and NULs at the end."""
    return F.rtrim(raw, F.lit(" \x00"))


def track_name(raw: Column) -> Column:
    """A v-track's own name, empty for the default one `V.T` with nothing, a space or a digit after it."""
    name = F.trim(raw)
    return F.when(name.rlike(r"^V\.T($|[ 0-9])"), "").otherwise(name)


def file_name(raw: Column) -> Column:
    """A name that can stand in a path."""
    return F.trim(F.translate(raw, "/", "_"))


def bit_depth(format_code: Column) -> Column:
    return F.when(format_code.isin(5, 8), 24).otherwise(16)


def severity_name(level: Column) -> Column:
    return F.when(level == 0, "info").when(level == 1, "warning").when(level == 2, "error").otherwise("unknown")


def deviation_text(level: Column, reference: Column, location: Column, message: Column) -> Column:
    """`deviation [severity reference] location: message`; an empty reference is left out."""
    head = F.concat_ws(" ", severity_name(level), F.when(reference != "", reference))
    return F.concat(F.lit("deviation ["), head, F.lit("] "), location, F.lit(": "), message)
