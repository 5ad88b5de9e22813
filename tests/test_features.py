"""Exact imputation, scaling and one-hot semantics (M1-M5)."""

import math

from pyspark.ml.functions import vector_to_array

from intentlab.operators.features import ExactScaler, ModeImputer, build_preprocessor, mode_values, numeric_fill_values


def test_impute_small_fixture(spark):
    df = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (3.0, "b"), (10.0, "a"), (None, None)], "x double, s string")
    assert numeric_fill_values(df, ["x"], "median") == {"x": 2.5}
    assert numeric_fill_values(df, ["x"], "mean") == {"x": 4.0}
    m = ExactScaler(inputCols=["x"], outputCols=["z"]).fit(df)
    fills, means, scales = (m.getOrDefault(p) for p in (m.fills, m.means, m.scales))
    vals = [1.0, 2.0, 3.0, 10.0, 2.5]
    mu = sum(vals) / 5
    sd = math.sqrt(sum((v - mu) ** 2 for v in vals) / 5)
    assert fills == [2.5] and abs(means[0] - mu) < 1e-12 and abs(scales[0] - sd) < 1e-12
    mi = ModeImputer(inputCols=["s"], outputCols=["s2"]).fit(df)
    assert mi.getOrDefault(mi.modes) == ["a"]  # tie between a and b -> smallest
    assert [r.s2 for r in mi.transform(df).collect()][-1] == "a"


def test_mode_of_codes_uses_numeric_order(spark):
    df = spark.createDataFrame([(10,), (10,), (2,), (2,), (3,)], "Browser int")
    assert mode_values(df, ["Browser"]) == {"Browser": "2"}


def test_zero_variance_scales_by_one(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    m = ExactScaler(inputCols=["x"], outputCols=["z"]).fit(df)
    assert m.getOrDefault(m.scales) == [1.0]
    assert [r.z for r in m.transform(df).collect()] == [0.0, 0.0]


def _sessions(spark, rows):
    from intentlab import schema as S
    return spark.createDataFrame(rows, S.KEYED_SESSION_SCHEMA)


def _row(i, month="Mar", vt="Returning_Visitor", browser=2, pv=1.0):
    return (i, 1, 1.0, 0, 0.0, 3, 10.0, 0.1, 0.2, pv, 0.0, month, vt, 1, browser, 1, 1, False, i % 2 == 0)


def test_unseen_categories_encode_as_zeros(spark):
    train = _sessions(spark, [_row(i, month=("Mar" if i % 2 else "Nov")) for i in range(20)])
    test = _sessions(spark, [_row(100, month="Jun", vt="Robot", browser=99), _row(101)])
    model = build_preprocessor().fit(train)
    out = model.transform(test).select("session_id", vector_to_array("features").alias("f")).collect()
    f_unseen, f_seen = out[0].f, out[1].f
    n_num = 10
    assert len(f_unseen) == len(f_seen)
    # Month, VisitorType, Browser blocks: seen row has one 1 per block, unseen has none there
    assert sum(f_seen[n_num:]) == 7
    assert sum(f_unseen[n_num:]) == 7 - 3


def test_excluded_features_absent(spark):
    from intentlab.operators.features import feature_names
    train = _sessions(spark, [_row(i) for i in range(10)])
    model = build_preprocessor(excluded_features=["Technical", "Engagement"]).fit(train)
    names = feature_names(model.transform(train))
    for gone in ("BounceRates", "ExitRates", "PageValues"):
        assert gone not in names
    assert not any(n.startswith(("Browser", "Region", "OperatingSystems", "TrafficType")) for n in names)
