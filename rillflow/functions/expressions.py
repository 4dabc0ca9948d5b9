"""Scalar expressions that several plans share, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def epoch_ms(iso: Column) -> Column:
    """Milliseconds since 1970 of ISO text, cut off below a millisecond; null if it doesn't parse."""
    return F.unix_millis(F.try_to_timestamp(iso))


def iso_ms(ts: Column) -> Column:
    """ISO text with milliseconds and Z, whatever time zone the session has."""
    ms = F.unix_millis(ts)
    day = F.floor(ms / 86_400_000).cast("int")
    rest = ms - day.cast("long") * 86_400_000
    part = lambda unit, most: F.floor(rest / unit) % most
    return F.format_string("%sT%02d:%02d:%02d.%03dZ", F.date_from_unix_date(day).cast("string"), part(3_600_000, 24), part(60_000, 60), part(1000, 60), rest % 1000)


def elapsed_ms(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / 1000


def keyset_after(first: Column, second: Column, a: object, b: object) -> Column:
    """(first, second) < (a, b) written so that the scan can use it."""
    return (first < F.lit(a)) | ((first == F.lit(a)) & (second < F.lit(b)))


def cursor_of(*parts: Column) -> Column:
    """The cursor text of each row, as ``functions.cursors.encode`` makes it."""
    joined = F.concat_ws(",", *[p.cast("string") for p in parts])
    return F.rtrim(F.translate(F.base64(F.encode(joined, "UTF-8")), "+/=\r\n", "-_ "))


def cursor_parts(cursor: Column, longest: int) -> Column:
    """The values of each row's cursor as text; null where it is no cursor."""
    ours = cursor.rlike(f"^[A-Za-z0-9_-]{{1,{longest}}}$")
    padded = F.concat(F.translate(cursor, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(cursor), F.lit(4))))
    return F.when(ours, F.split(F.try_to_binary(padded, F.lit("base64")).try_cast("string"), ",", -1))


def last_match(text: Column, pattern: str) -> Column:
    """Group 1 of the pattern's last match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def padded_id(prefix: str, number: Column, width: int) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def prefixed(prefix: str, value: Column) -> Column:
    """A line for inspection sinks."""
    return F.concat(F.lit(f"{prefix}: "), value)
