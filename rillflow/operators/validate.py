"""Structural validation of raw JSON records, and the split into valid records and dead letters.

The first failing check gives the reason: ``malformed_json``, then
``invalid_type:root``, then for each required field in order
``missing_field:F`` or ``invalid_type:F``.  All of it is VARIANT expressions,
so it stays in the JVM and needs no shuffle; a record is parsed once, for its
reason and its fields alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..schema import REQUIRED_FIELDS

DUPLICATE_KEYS = "spark.sql.variant.allowDuplicateKeys"
TIMES, NUMBERS = ("event_time", "ingest_time"), {"amount": "bigint", "schema_version": "int"}
UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"


def _parsed(records: DataFrame, raw: str) -> DataFrame:
    """Adds ``_record`` (VARIANT), null where the text isn't exactly one JSON value, and ``_held``, its fields, null where it is no object.

    A parser that stops after a value would let text behind it pass.  So the
    text is read as the first entry of an array whose second is the text's own
    hash: only one whole value leaves both in place.
    """
    spark = records.sparkSession
    before = spark.conf.get(DUPLICATE_KEYS, None)
    spark.conf.set(DUPLICATE_KEYS, "true")  # the last of equal keys holds; read when the expression is analysed
    try:
        own = F.xxhash64(raw).cast("string")
        array = F.try_parse_json(F.concat(F.lit("["), F.col(raw), F.lit(","), own, F.lit("]"))).try_cast("array<variant>")
        whole = (F.size(array) == 2) & (F.get(array, F.lit(1)).try_cast("string") == own)
        found = records.withColumn("_record", F.when(whole, F.get(array, F.lit(0))))
        return found.withColumn("_held", F.col("_record").try_cast("map<string,variant>"))  # fields are looked up, not searched for by a path each time
    finally:
        if before is None:
            spark.conf.unset(DUPLICATE_KEYS)
        else:
            spark.conf.set(DUPLICATE_KEYS, before)


def _field(name: str, kind: str = "variant") -> Column:
    found = F.try_element_at("_held", F.lit(name))
    return found if kind == "variant" else found.try_cast(kind)


def _reason(strict: bool) -> Column:
    reason = F.when(F.col("_record").isNull(), "malformed_json").when(F.col("_held").isNull(), "invalid_type:root")
    for name, kind in REQUIRED_FIELDS.items():
        reason = reason.when(_field(name).isNull(), f"missing_field:{name}").when(F.schema_of_variant(_field(name)) != kind, f"invalid_type:{name}")
    if strict:
        for name in TIMES:
            reason = reason.when(F.try_to_timestamp(_field(name, "string")).isNull(), f"unparseable:{name}")
        reason = reason.when(~_field("event_id", "string").rlike(UUID), "unparseable:event_id")
    return reason


def _once(records: DataFrame, columns: list[Column], kept: list[Column]) -> DataFrame:
    """``kept`` and the computed columns, as a generator of one row: filters on them stay above, so that they are computed once."""
    return records.select(*kept, F.inline(F.array(F.struct(*columns))))


def with_reason(records: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """All rows with ``reason_code``, null where the record is valid.

    ``strict`` adds ``unparseable:F`` for ids and times that the types can't hold.
    """
    return _once(_parsed(records, raw), [_reason(strict).alias("reason_code")], [F.col(c) for c in records.columns])


def judged(records: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """All rows with ``reason_code``, the fields as far as they have their types, and the other columns of the input.

    Times that don't parse are null.  ``split`` takes it apart.
    """
    fields = [(F.try_to_timestamp(_field(f, "string")) if f in TIMES else _field(f, NUMBERS.get(f, "string"))).alias(f) for f in REQUIRED_FIELDS]
    kept = [F.col(raw).alias("raw_record"), *[F.col(c) for c in records.columns if c != raw and c not in REQUIRED_FIELDS]]
    return _once(_parsed(records, raw), [_reason(strict).alias("reason_code"), *fields], kept)


def split(judged_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid events, and dead letters."""
    return judged_.where("reason_code is null").drop("reason_code", "raw_record"), judged_.where("reason_code is not null").select("reason_code", "raw_record")


def dead_letters(records: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """reason_code and raw_record of the rows that fail."""
    return with_reason(records, raw, strict).where("reason_code is not null").select("reason_code", F.col(raw).alias("raw_record"))


def valid_events(records: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """The typed fields of the rows that pass, with the other columns of the input.  Times that don't parse are null."""
    return split(judged(records, raw, strict))[0]
