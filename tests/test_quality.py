"""Validation report on dirty hand-made sessions (boundaries of A1-A9)."""

import math

from intentlab import schema as S
from intentlab.operators import prepare, quality


def _session(i, **kw):
    base = dict(Administrative=1, Administrative_Duration=10.0, Informational=0, Informational_Duration=0.0,
                ProductRelated=5, ProductRelated_Duration=100.0, BounceRates=0.1, ExitRates=0.2, PageValues=1.0,
                SpecialDay=0.0, Month="Mar", VisitorType="Returning_Visitor", OperatingSystems=1, Browser=1, Region=1,
                TrafficType=1, Weekend=False, Revenue=bool(i % 5 == 0))
    base.update(kw)
    return tuple([i] + [base[c] for c in S.ALL_FEATURES] + [base["Revenue"]])


def _frame(spark, rows):
    return spark.createDataFrame(rows, S.KEYED_SESSION_SCHEMA)


def test_too_few_rows_is_an_error_and_stops_checks(spark):
    rep = quality.validation_report(_frame(spark, [_session(i) for i in range(499)]).drop(S.KEY)).first()
    assert not rep.passed
    assert rep.errors == ["Too few rows: 499 (minimum 500)"]
    assert dict(rep.stats) == {"row_count": 499.0}


def test_dirty_rows_warnings(spark):
    rows = [_session(i) for i in range(500)]
    rows[0] = _session(0, BounceRates=-0.1)
    rows[1] = _session(1, BounceRates=1.1, ExitRates=float("nan"))
    rows[2] = _session(2, ExitRates=None, Weekend=None)
    rows[3] = _session(3)  # duplicate of many identical rows
    rep = quality.validation_report(_frame(spark, rows).drop(S.KEY)).first()
    assert rep.passed
    assert "BounceRates has 2 values outside [0, 1]" in rep.warnings
    assert not any(w.startswith("ExitRates has") for w in rep.warnings)  # NaN is not out of range
    st = dict(rep.stats)
    assert st["row_count"] == 500.0
    assert st["null_pct_ExitRates"] == 0.4 and st["null_pct_Weekend"] == 0.2
    assert st["columns_with_nulls"] == 2.0
    assert st["duplicate_rows"] > 0


def test_all_null_column_and_missing_columns(spark):
    rows = [_session(i, Month=None) for i in range(500)]
    rep = quality.validation_report(_frame(spark, rows).drop(S.KEY)).first()
    assert not rep.passed and rep.errors == ["Columns are entirely null: ['Month']"]
    rep2 = quality.validation_report(_frame(spark, rows).drop(S.KEY, "PageValues")).first()
    assert rep2.errors == ["Missing columns: ['PageValues']"] and dict(rep2.stats) == {"row_count": 500.0}


def test_purchase_rate_warning_and_duplicates(spark):
    rows = [_session(i, Revenue=True) for i in range(600)]
    rep = quality.validation_report(_frame(spark, rows).drop(S.KEY)).first()
    assert any(w.startswith("Purchase rate is unusually high: 100.0%") for w in rep.warnings)
    assert dict(rep.stats)["duplicate_rows"] == 599.0


def test_drop_duplicates_keeps_smallest_key_and_nulls_equal(spark):
    rows = [_session(10, Weekend=None, Revenue=False), _session(3, Weekend=None, Revenue=False),
            _session(7, Month="Nov", Revenue=False)]
    out = prepare.drop_duplicates(_frame(spark, rows)).orderBy(S.KEY).collect()
    assert [r[S.KEY] for r in out] == [3, 7]


def test_domain_validate_rows_defaults_and_violations(spark):
    rows = [_session(1, BounceRates=1.5, Browser=0), _session(2, PageValues=None, Month=None)]
    out = {r[S.KEY]: r for r in prepare.domain_validate_rows(_frame(spark, rows)).collect()}
    assert out[1].violations == ["BounceRates", "Browser"] and not out[1].accepted
    assert out[2].accepted and out[2].PageValues == 0.0 and out[2].Month == "Nov"
    assert not math.isnan(out[2].PageValues)
