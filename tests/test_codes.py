"""Validator vectors."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from dqflow.functions import codes as C
from dqflow.functions import scalars as X


def column(spark, values, build):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["o"] for r in df.select("i", build("v").alias("o")).orderBy("i").collect()]


def valid(spark, values, build):
    return [r["valid"] for r in column(spark, values, build)]


def test_npi(spark):
    good = ["1234567893", "1679576722", "1234567810", "123-456-7893"]
    bad = ["1234567890", "1111111111", "123456789", "ABCD567893", "", None, "9876543210", "0000000000"]
    assert all(valid(spark, good, C.validate_npi)) and not any(valid(spark, bad, C.validate_npi))


def test_luhn(spark):
    assert column(spark, ["79927398713", "79927398710", "", None, "12a"], C.luhn) == [True, False, False, False, False]


def test_member_id(spark):
    good = ["123456789", "123456789012", "CA123456789", "a12345678b", " A12345678B "]
    assert all(valid(spark, good, C.validate_member_id))
    assert not any(valid(spark, ["12345", "INVALID", "", None], C.validate_member_id))
    assert column(spark, ["123456789", "ca123456789", "A12345678B", "12345"], C.is_member_id_engine) == [True, True, True, False]
    assert column(spark, ["ca123456789", "CA123456789", None], C.is_member_id_silver) == [False, True, False]


def test_diagnosis(spark):
    good = ["Z00.00", "I10", "E11.9", "J45.909", "M79.3", "F32.9", "K21.9"]
    out = column(spark, good, C.validate_diagnosis)
    assert all(r["valid"] and r["format"] == "ICD-10" for r in out)
    legacy = column(spark, ["123.45"], C.validate_diagnosis)[0]
    assert legacy["valid"] and legacy["format"] == "ICD-9" and legacy["warning"]
    assert not any(valid(spark, ["INVALID", "A", "Z00.00.00", "U99.99", "", None], C.validate_diagnosis))


def test_icd10_extended(spark):
    out = column(spark, ["S72.0", "S72", "U07.1", "Z00", "A1", "I10.12345"], C.validate_icd10_extended)
    assert [r["error"] for r in out] == [None, "decimal required", "reserved first letter", None, "length", "length"]


def test_procedures(spark):
    assert all(valid(spark, ["99213", "99214", "80053", "36415", "85025", "90791", "96116", "99999"], C.validate_cpt))
    assert not any(valid(spark, ["9921", "992133", "ABCDE", "", "00000", None], C.validate_cpt))
    assert column(spark, ["00000", "99213"], C.is_cpt_format) == [True, True]
    assert column(spark, ["99213", "0001F", "0001T", "0000F", "99500"], C.cpt_category) == ["I", "II", "III", "none", "none"]
    assert valid(spark, ["j1234", "I1234", "W1234"], C.validate_hcpcs) == [True, False, False]
    assert column(spark, ["J1234", "F1234"], C.hcpcs_category) == ["Drugs Administered Other Than Oral Method", None]
    ndc = ["12345-1234-12", "1234-1234-12", "12345-123-12", "12345678901", "1234"]
    assert column(spark, ndc, C.ndc_format) == ["5-4-2", "4-4-2", "5-3-2", "11-digit", None]


def test_dates(spark):
    as_of = dt.date(2024, 6, 1)
    build = lambda c: C.validate_service_date(c, as_of)
    out = column(spark, ["2024-01-15", "01/15/2024", "20240115", "2019-12-31", "2025-01-01", "invalid-date", "2024-02-31", None], build)
    assert [r["clean_value"] for r in out] == ["2024-01-15"] * 3 + [None] * 5
    rows = spark.createDataFrame([("2024-01-10", "2024-01-12"), ("2024-01-13", "2024-01-12"), ("2024-01-10", None), (None, "2024-01-01")], "a string, s string")
    assert [r[0] for r in rows.select(C.validate_admission("a", "s")["valid"]).collect()] == [True, False, True, False]
    stays = spark.createDataFrame([("2024-01-10", "2022-01-12"), ("2021-01-13", "2022-01-12")], "d string, a string")
    got = [tuple(r) for r in stays.select(C.validate_discharge("d", "a")["valid"], C.validate_discharge("d", "a")["warning"]).collect()]
    assert got == [(True, "stay longer than 365 days"), (False, None)]


def test_amount_and_place(spark):
    out = column(spark, ["$ 1,234.567", "0", "-5", "1000000.01", "abc", None], C.validate_claim_amount)
    assert [r["clean_value"] for r in out] == ["1234.57", "0.00", None, None, None, None]
    assert out[1]["warning"] == "zero amount"
    assert [r["clean_value"] for r in column(spark, ["1", "99", "00", "100", "x"], C.validate_place_of_service)] == ["01", "99", None, None, None]


@pytest.mark.parametrize("state,good,bad", [("CA", "CA123456789", "CA12345678"), ("NY", "12345678NY", "NY12345678"), ("TX", "TXA12345678", "TX12345678")])
def test_state_ids(spark, state, good, bad):
    assert column(spark, [good, bad], lambda c: C.state_member_id(F.lit(state), c)) == [True, False]


def test_phone(spark):
    got = column(spark, ["555-123-4567", "(555) 123-4567", "15551234567", "+15551234567", "123", None], X.standardize_phone)
    assert got == ["5551234567"] * 4 + ["123", None]


def test_record(spark):
    df = spark.createDataFrame(
        [("123456789", "1234567893", "2024-01-15"), ("bad", "1234567890", "nope")], "member_id string, provider_npi string, service_date string"
    )
    schema = {"member_id": "member_id", "provider_npi": "npi", "service_date": "service_date", "gone": "npi", "member_id2": "x"}
    out = C.validate_records(df, schema, dt.date(2024, 6, 1)).orderBy("member_id").collect()
    assert [len(r["errors"]) for r in out] == [2, 5]
    good = C.validate_records(df, {"member_id": "member_id", "provider_npi": "npi"}, dt.date(2024, 6, 1))
    assert [r["valid"] for r in good.orderBy("member_id").collect()] == [True, False]
