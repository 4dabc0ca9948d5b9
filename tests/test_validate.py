import json

import pytest

from rillflow.operators import validate
from rillflow.schema import REQUIRED_FIELDS

GOOD = {"event_id": "e", "user_id": "u", "merchant_id": "m", "amount": 5, "currency": "USD", "transaction_type": "t", "event_time": "2024-01-01T00:00:00Z", "ingest_time": "2024-01-01T00:00:00Z", "schema_version": 1}


def without(*names):
    return json.dumps({k: v for k, v in GOOD.items() if k not in names})


def with_(**given):
    return json.dumps(GOOD | given)


CASES = [
    ("{bad", "malformed_json"), ("", "malformed_json"), (json.dumps(GOOD) + " x", "malformed_json"), ("{'a':1}", "malformed_json"), ("1,2", "malformed_json"), ("1},{", "malformed_json"),
    ('1,"r":2', "malformed_json"), ("[1]", "invalid_type:root"), ("null", "invalid_type:root"), ('"s"', "invalid_type:root"), ("5", "invalid_type:root"),
    (without("amount"), "missing_field:amount"), (without("user_id", "amount"), "missing_field:user_id"), (with_(amount="12"), "invalid_type:amount"), (with_(amount=True), "invalid_type:amount"),
    (with_(amount=None), "invalid_type:amount"), (with_(amount={}), "invalid_type:amount"), (with_(amount=1.0), "invalid_type:amount"), (with_(amount=2**70), "invalid_type:amount"),
    (json.dumps(GOOD).replace('"amount": 5', '"amount": 1e3'), "invalid_type:amount"), (with_(schema_version=True), "invalid_type:schema_version"), (with_(event_id=7), "invalid_type:event_id"),
    (with_(amount=-5, currency="ZZZ", transaction_type="unknown"), None), (with_(extra=[1]), None), (with_(event_time="not a time"), None), (json.dumps(GOOD)[:-1] + ', "amount": "x"}', "invalid_type:amount"),
]


def test_reasons(spark):
    rows = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(CASES)] + [(len(CASES), None)], "seq int, raw string")
    got = {r["seq"]: r["reason_code"] for r in validate.with_reason(rows).collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)} | {len(CASES): "malformed_json"}


@pytest.mark.parametrize("field", REQUIRED_FIELDS)
def test_each_field(spark, field):
    rows = spark.createDataFrame([(without(field),), (with_(**{field: []}),)], "raw string")
    assert [r["reason_code"] for r in validate.with_reason(rows).collect()] == [f"missing_field:{field}", f"invalid_type:{field}"]


def test_strict_and_split(spark):
    uuid = "00000000-0000-4000-a000-000000000001"
    rows = spark.createDataFrame([(1, with_()), (2, with_(event_id=uuid)), (3, with_(event_id=uuid, event_time="x")), (4, "[")], "seq int, raw string")
    assert [r["reason_code"] for r in validate.dead_letters(rows, strict=True).collect()] == ["unparseable:event_id", "unparseable:event_time", "malformed_json"]
    valid = validate.valid_events(rows, strict=True).collect()
    assert [(r["seq"], r["event_id"], r["amount"], r["schema_version"]) for r in valid] == [(2, uuid, 5, 1)]
    assert validate.valid_events(rows.limit(0)).count() == 0
