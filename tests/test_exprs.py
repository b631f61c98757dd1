"""Branch tables for the scalar expressions (F1-F34): (input, expected) rows taken from the rules."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from spooltrace.functions import exprs as X


def _eval(spark, rows, schema, expr):
    df = spark.createDataFrame(rows, schema)
    return [r[0] for r in df.select(expr.alias("out")).collect()]


def test_parse_bigint(spark):
    rows = [("123",), (" 7 ",), ("1,234",), ("12.0",), ("1.2E3",), ("abc",), (None,), ("",)]
    assert _eval(spark, rows, "x string", X.parse_bigint(F.col("x"))) == [123, 7, 1234, 12, 1200, None, None, None]


def test_parse_bigint_strict(spark):
    rows = [("123",), (" 7 ",), ("12.0",), ("1,234",), ("n/a",)]
    assert _eval(spark, rows, "x string", X.parse_bigint_strict(F.col("x"))) == [123, 7, None, None, None]


def test_parse_decimal_comma(spark):
    rows = [("612,5",), ("600",), ("0,25",), ("x",)]
    out = _eval(spark, rows, "x string", X.parse_decimal_comma(F.col("x"), 6, 3))
    assert out == [Decimal("612.500"), Decimal("600.000"), Decimal("0.250"), None]


def test_parse_date_multi_order(spark):
    rows = [("05.01.2024",), ("05-01-2024",), ("01/05/2024",), ("13/01/2024",), ("45292",),
            ("2024-01-05 10:11:12",), ("garbage",), ("2024",)]
    out = _eval(spark, rows, "x string", X.parse_date_multi(F.col("x")))
    assert out[0] == dt.datetime(2024, 1, 5)
    assert out[1] == dt.datetime(2024, 1, 5)
    assert out[2] == dt.datetime(2024, 1, 5)          # MM/dd wins over dd/MM
    assert out[3] == dt.datetime(2024, 1, 13)         # only dd/MM parses
    assert out[4] == dt.datetime(2023, 12, 30)        # serial 45292 with the -2 offset
    assert out[5] == dt.datetime(2024, 1, 5, 10, 11, 12)
    assert out[6] is None
    assert out[7] == dt.datetime(1899, 12, 30) + dt.timedelta(days=2024 - 2)  # a bare number is a serial, not a year


def test_clean_key_and_lot_prefix(spark):
    rows = [("tr 5\t",), (" x y ",)]
    assert _eval(spark, rows, "x string", X.clean_key(F.col("x"))) == ["TR 5", "X Y"]
    rows = [("L12-345",), ("L12",), ("a-b-c",)]
    assert _eval(spark, rows, "x string", X.lot_prefix(F.col("x"))) == ["L12", "L12", "a"]


def test_pass_fail(spark):
    rows = [("nein",), (" Ja",), ("OK",), (None,), ("??",), ("rejected",)]
    assert _eval(spark, rows, "x string", X.pass_fail(F.col("x"))) == ["FAIL", "PASS", "PASS", "PASS", "PASS", "FAIL"]


@pytest.mark.parametrize("status,second,expected", [
    (None, "NO", "Waste"), (None, "YES", "B-Ware"), (None, "", "Waste"), ("FAIL", "NO", "Waste"),
    ("FAIL", "YES", "B-Ware"), ("FAIL", "MAYBE", "Waste"), ("PASS", "YES", "B-Ware"), ("PASS", "NO", "Passed"),
    ("PASS", "", "Passed"), ("OTHER", "YES", "Passed"),
])
def test_qc_result_matrix(spark, status, second, expected):
    out = _eval(spark, [(status, second)], "s string, r string", X.qc_result_matrix(F.col("s"), F.col("r")))
    assert out == [expected]


def test_treatment_status_and_notes(spark):
    rows = [("AT GEB", "Op 1"), ("AT BBF", ""), ("YES", None), ("NO", "x")]
    df = spark.createDataFrame(rows, "t string, o string")
    out = df.select(X.treatment_status(F.col("t")).alias("s"), X.treatment_notes(F.col("t"), F.col("o")).alias("n")).collect()
    assert [r.s for r in out] == ["Inspected", "Shipped", "Shipped", None]
    assert out[0].n == "LegacyTreatmentID=AT GEB; Operator=Op 1"
    assert out[1].n == "LegacyTreatmentID=AT BBF"


def test_base36_lot_and_code(spark):
    rows = [(0,), (35,), (36,), (1295,), (46655,)]
    assert _eval(spark, rows, "n long", X.base36(F.col("n"))) == ["0", "Z", "10", "ZZ", "ZZZ"]
    df = spark.createDataFrame([(dt.datetime(2025, 3, 1), 5), (dt.datetime(2025, 3, 1), 46655)], "ts timestamp, n long")
    assert [r[0] for r in df.select(X.lot_number(F.col("ts"), F.col("n"))).collect()] == ["2505", "25ZZZ"]
    df = spark.createDataFrame([("2505", 7)], "lot string, seq int")
    assert df.select(X.product_code(F.col("lot"), F.col("seq"))).first()[0] == "25050007"


def test_name_initials(spark):
    rows = [("Heiko Müller",), ("anna",), ("J. R. Smith",), (None,), ("  ",), ("X",)]
    assert _eval(spark, rows, "x string", X.name_initials(F.col("x"))) == ["HeMü", "AnAn", "JjSm", "XxXx", "XxXx", "XxXx"]


@pytest.mark.parametrize("w,p,expected", [(930, 1, "Passed"), (850, 1, "B-Ware"), (0, 1, "Passed"), (930, 6, "Waste"),
                                          (2000, 7, "Waste")])
def test_harvest_qc_rule(spark, w, p, expected):
    out = _eval(spark, [(w, float(p))], "w int, p double",
                X.harvest_qc_rule(F.col("w"), F.col("p"), F.lit(930), F.lit(46)))
    assert out == [expected]


@pytest.mark.parametrize("prior,req,surf,ster,quar,vis,expected", [
    ("A-Ware", True, True, False, False, True, "Waste"),
    ("A-Ware", True, True, True, False, False, "Waste"),
    ("A-Ware", True, False, True, False, True, "Waste"),
    ("A-Ware", False, False, True, True, True, "Quarantine"),
    ("A-Ware", False, True, True, False, True, "Passed"),
    ("B-Ware", False, True, True, False, True, "B-Ware"),
    ("A-Ware", False, False, True, False, True, "B-Ware"),
])
def test_treatment_qc_rule(spark, prior, req, surf, ster, quar, vis, expected):
    df = spark.createDataFrame([(prior, req, surf, ster, quar, vis)],
                               "p string, r boolean, s boolean, t boolean, q boolean, v boolean")
    out = df.select(X.treatment_qc_rule(*[F.col(x) for x in "prstqv"])).first()[0]
    assert out == expected


def test_business_status_and_targets(spark):
    rows = [("Passed",), ("Quarantine",), ("Waste",), ("weird",), (None,)]
    assert _eval(spark, rows, "x string", X.business_status(F.col("x"), "A-Ware")) == [
        "A-Ware", "In Quarantine", "Waste", "A-Ware", "A-Ware"]
    rows = [("Waste", "anything"), ("Passed", "Harvest QC Complete; Pending Storage"),
            ("B-Ware", "Returned / Post-Treatment QC; Pending Storage"),
            ("Passed", "Returned / Post-Treatment QC; Pending Storage"), ("Passed", "Other")]
    assert _eval(spark, rows, "r string, s string", X.qm_target_stage(F.col("r"), F.col("s"))) == [
        "Discarded Product", "QM Approved for Treatment; Pending Treatment", "Internal Use/Client",
        "QM Approved For Sales; Pending Sales", "Other"]


def test_resolution_and_notes(spark):
    df = spark.createDataFrame([("Passed",), ("B-Ware",), ("Waste",)], "r string")
    st = X.resolution_status(F.col("r"))
    out = df.select(st["investigation_status"], st["quarantine_status"]).collect()
    assert [tuple(r) for r in out] == [("Cleared A-Ware", "Released"), ("Cleared B-Ware", "Released"),
                                       ("Disposed", "Disposed")]
    df = spark.createDataFrame([(None, "n"), ("", "n"), ("old", "n")], "o string, n string")
    assert [r[0] for r in df.select(X.append_note(F.col("o"), F.col("n"))).collect()] == ["n", "n", "old\rn"]


def test_weight_health_expiry_required(spark):
    rows = [(None,), (499.0,), (500.0,), (2499.0,), (2500.0,)]
    assert _eval(spark, rows, "w double", X.weight_health(F.col("w"))) == [None, "Critical", "Low", "Low", "OK"]
    df = spark.createDataFrame([(dt.datetime(2024, 2, 29),)], "d timestamp")
    e = X.label_expiry(F.col("d"))
    assert tuple(df.select(e["expiry_date"], e["expiry_label"]).first()) == ("2026-02-28", "2 / 2026")
    df = spark.createDataFrame([(Decimal("930.00"), Decimal("46.00")), (None, None)], "a decimal(7,2), b decimal(4,2)")
    assert [r[0] for r in df.select(X.required_weight(F.col("a"), F.col("b"))).collect()] == [
        Decimal("986.00"), Decimal("0.00")]


def test_levels_and_outcome(spark):
    df = spark.createDataFrame([("Admin", "Write"), ("Read", "Write"), ("Write", "Write")], "u string, r string")
    assert [r[0] for r in df.select(X.has_level(F.col("u"), F.col("r"))).collect()] == [True, False, True]
    df = spark.createDataFrame([(None,), ("B-Ware",), ("Waste",)], "d string")
    assert [r[0] for r in df.select(X.reason_matches_outcome(F.col("d"), "B-Ware")).collect()] == [True, True, False]
