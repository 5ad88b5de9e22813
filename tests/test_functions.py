"""Boundary behaviour of the column functions on hand-made rows."""

from pyspark.sql import functions as F

from intentlab.functions import columns as C


def _rows(spark, values, schema="p double"):
    return spark.createDataFrame([(v,) for v in values], schema)


def test_intervene_lower_is_strict_and_range_inclusive(spark):
    df = _rows(spark, [0.0, 0.15, 0.30, 0.35, 0.50, 0.65, 0.70, 0.85, 1.0])
    got = df.select("p", C.intervene("p", "lower", 0.30).alias("lo"),
                    C.intervene("p", "range", 0.30, 0.70).alias("rg"),
                    C.intervene("p", "other", 0.30, 0.70).alias("other")).collect()
    by_p = {r.p: r for r in got}
    assert by_p[0.30].lo is False and by_p[0.15].lo is True
    assert by_p[0.30].rg is True and by_p[0.70].rg is True and by_p[0.85].rg is False and by_p[0.15].rg is False
    assert all(r.other == r.lo for r in got)  # any mode other than "range" acts as "lower"


def test_confidence_buckets_strict(spark):
    vals = [0.0, 0.15, 0.149, 0.35, 0.5, 0.65, 0.651, 0.85, 0.851, 1.0, 0.2, 0.8]
    got = {r.p: r.c for r in _rows(spark, vals).select("p", C.confidence_bucket("p").alias("c")).collect()}

    def ref(p):  # the rule evaluated in Python, floating point included
        gap = abs(p - 0.5)
        return "High" if gap > 0.35 else "Medium" if gap > 0.15 else "Low"

    assert got == {v: ref(v) for v in vals}
    assert got[0.5] == "Low" and got[1.0] == "High" and got[0.8] == "Medium"


def test_predicted_class_tie_goes_to_zero(spark):
    got = {r.p: r.c for r in _rows(spark, [0.5, 0.5000001, 0.4999]).select(
        "p", C.predicted_class("p").alias("c")).collect()}
    assert got == {0.5: 0, 0.5000001: 1, 0.4999: 0}


def test_weekend_text_round_trip(spark):
    df = spark.createDataFrame([("True",), ("true",), ("1",), ("TRUE",), ("0",), (None,)], "w string")
    got = [r.x for r in df.select(C.weekend_from_text("w").alias("x")).collect()]
    assert got == [True, True, True, False, False, False]
    b = spark.createDataFrame([(True,), (False,), (None,)], "Weekend boolean")
    assert [r.t for r in b.select(C.weekend_to_text().alias("t")).collect()] == ["True", "False", "nan"]


def test_integer_normalise_truncates_toward_zero(spark):
    df = _rows(spark, [1.9, -1.9, 2.0, -0.5])
    assert [r.i for r in df.select(C.integer_normalise("p").alias("i")).collect()] == [1, -1, 2, 0]


def test_month_ordinal_unlisted_is_null(spark):
    df = spark.createDataFrame([("Feb",), ("Dec",), ("Jan",), ("Jun",), (None,)], "Month string")
    assert [r.o for r in df.select(C.month_ordinal().alias("o")).collect()] == [1, 10, None, None, None]


def test_percent_text_uses_python_rounding(spark):
    vals = [0.1495, 0.0005, 0.12345, None]
    got = [r.t for r in _rows(spark, vals).select(C.percent_text("p").alias("t")).collect()]
    want = [f"{v * 100:.1f}%" if v is not None else "—" for v in vals]
    assert got == want


def test_threshold_text_and_label(spark):
    df = spark.createDataFrame(
        [("range", 0.3, 0.7), ("lower", 0.3, 1.0), (None, None, None), ("range", 0.3, None)],
        "m string, lo double, hi double")
    got = df.select(
        C.threshold_text("m", "lo", "hi", F.lit("range"), F.lit(0.25), F.lit(0.75)).alias("t"),
        C.wdr_label("m", "lo", "hi").alias("l")).collect()
    assert [r.t for r in got] == ["30% – 70%", "< 30%", "25% – 75%", "< 30%"]
    assert [r.l for r in got] == ["Wasted Discount (30%–70%)", "Wasted Discount (< 30%)", "Wasted Discount",
                                  "Wasted Discount (< 30%)"]


def test_scorecard_bounds_and_null_page_values(spark):
    df = spark.createDataFrame(
        [(200, "Returning_Visitor", 1000.0, 0.0, True, 1.0, "Nov"),
         (1, "New_Visitor", 0.0, 1.0, False, 0.0, "Jan"),
         (5, "Other", None, None, False, 0.0, "Mar")],
        "ProductRelated int, VisitorType string, PageValues double, BounceRates double, Weekend boolean, "
        "SpecialDay double, Month string")
    got = [r.p for r in df.select(C.scorecard().alias("p")).collect()]
    assert got[0] == 0.95 and got[1] == 0.01 and got[2] == 0.01
