"""Exact order statistics by bracketing, and the fold cube, against numpy and against fitting each complement."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from intentlab import schema as S
from intentlab.config import materialize
from intentlab.operators import foldcube, prepare, selection, split
from intentlab.operators.features import build_preprocessor, numeric_fill_values
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL


def numbers(spark, n=4000, seed=3):
    rng = np.random.default_rng(seed)
    cols = {"wide": rng.normal(size=n) * 1e6, "heavy": np.where(rng.random(n) < 0.6, 7.0, rng.random(n)), "few": rng.integers(0, 4, n).astype(float),
            "gaps": np.where(rng.random(n) < 0.3, np.nan, rng.exponential(size=n)), "one": np.full(n, 2.5), "none": np.full(n, np.nan),
            "tail": np.where(rng.random(n) < 0.01, 1e300, rng.random(n) * 1e-300)}
    rows = [(int(i % 5), *(None if np.isnan(v) and i % 2 else float(v) for v in r)) for i, r in enumerate(zip(*cols.values()))]
    return spark.createDataFrame(rows, "fold int, " + ", ".join(f"{c} double" for c in cols)), cols


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.93, 1.0])
def test_quantiles_of_unions_of_groups(spark, q):
    df, cols = numbers(spark)
    slots = [selection.Slot(c, groups) for c in cols for groups in (None, (0, 1, 2, 4), (3,))]
    got = selection.exact_quantiles(df, slots, q, "fold")
    for slot, value in zip(slots, got):
        x = cols[slot.column]
        keep = np.isin(np.arange(len(x)) % 5, list(slot.groups)) if slot.groups else np.ones(len(x), bool)
        x = x[keep & ~np.isnan(x)]
        assert value is None if not len(x) else value == pytest.approx(np.quantile(x, q), rel=1e-12, abs=0), (slot, q)


def test_a_missed_bracket_grows(spark, monkeypatch):
    """The sketch decides what is read, not the result."""
    df, cols = numbers(spark)

    def wrong(sketches, group, slots, q):
        x = cols["wide"]
        lo, hi = (2e6, 2.1e6) if slots[0].groups is None else (-3e6, -2e6)
        return {0: (len(x), lo, hi, x.min(), x.max())}
    monkeypatch.setattr(selection, "_brackets", wrong)
    for groups in (None, (0, 1, 2, 3, 4)):
        assert selection.exact_quantiles(df, [selection.Slot("wide", groups)], 0.5, "fold") == [np.median(cols["wide"])]


def test_only_the_inside_is_shuffled(spark):
    df, cols = numbers(spark, 20000)
    x = np.sort(cols["wide"])
    rows = selection._inside(df, None, [selection.Slot("wide", None)], {0: (x[9900], x[10100])}).collect()
    assert len(rows) == 202 and sum(r["c"] for r in rows) == 10101
    assert [r["c"] for r in rows if r["value"] is None] == [9900]


def test_medians_of_empty_tables(spark):
    df, _ = numbers(spark)
    assert numeric_fill_values(df.where("false"), ["wide", "none"]) == {"wide": None, "none": None}
    assert numeric_fill_values(df, ["none"]) == {"none": None}


@pytest.fixture(scope="module")
def train(spark):
    labeled = prepare.project_features(load_sessions(spark, SF_SMALL))
    # some gaps in every kind of column
    holes = {"PageValues": F.when(F.col("session_id") % 7 != 0, F.col("PageValues")),
             "Month": F.when(F.col("session_id") % 11 != 0, F.col("Month")), "Browser": F.when(F.col("session_id") % 5 != 0, F.col("Browser"))}
    s = materialize(split.assign_split(labeled.withColumns(holes), "label"), "test-cube-split")
    return s.where(~F.col("is_test"))


@pytest.mark.parametrize("strategy,excluded", [("median", None), ("mean", ["Technical"])])
def test_every_complement_equals_its_own_fit(spark, train, strategy, excluded):
    cube = foldcube.measure(train, strategy=strategy, excluded_features=excluded)
    assert cube.folds == [0, 1, 2, 3, 4]
    for k in (0, 3, None):
        rows = train if k is None else train.where(F.col("fold") != k)
        plain = build_preprocessor(strategy, excluded).fit(rows)
        merged = foldcube.preprocessor(cube, train, k)
        a = plain.transform(train).select(S.KEY, vector_to_array("features").alias("a"))
        b = merged.transform(train).select(S.KEY, vector_to_array("features").alias("b"))
        apart = a.join(b, S.KEY).select(F.size("a") - F.size("b"), F.aggregate(
            F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda a, v: F.greatest(a, v)).alias("d"))
        assert apart.agg(F.max(F.abs(apart[0])), F.max("d"), F.count("*")).first()[:2] == pytest.approx((0, 0), abs=1e-9)
        statistics = cube.statistics(k)
        assert statistics.rows == rows.count() and statistics.positives == rows.where("label = 1").count()


def test_moments_merge_like_one_pass():
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1, 999)
    parts = [foldcube.Moments(len(p), float(p.mean()), float(((p - p.mean()) ** 2).sum())) for p in np.array_split(x, 7)]
    whole = sum(parts, foldcube.Moments())
    assert whole.n == 999 and whole.mean == pytest.approx(x.mean(), rel=1e-12)
    assert whole.squares == pytest.approx(((x - x.mean()) ** 2).sum(), rel=1e-8)
    assert foldcube.Moments() + foldcube.Moments() == foldcube.Moments()


def test_a_row_has_one_entry_a_column_however_many_slots(spark):
    """Overlapping unions of groups with unlike values, in one counting pass whose rows do not grow with the unions."""
    import numpy as np
    rng = np.random.default_rng(4)
    g, x, z = rng.integers(0, 5, 4000), rng.normal(size=4000), rng.integers(0, 7, 4000) * 1.0
    x = x + 100.0 * (g == 2)
    df = spark.createDataFrame([(int(a), float(b), float(c)) for a, b, c in zip(g, x, z)], "g int, x double, z double").repartition(3)
    unions = [tuple(f for f in range(5) if f != k) for k in range(5)] + [(2,), None]
    slots = [selection.Slot(c, u) for u in unions for c in ("x", "z")]
    got = selection.exact_quantiles(df, slots, 0.5, "g")
    want = [float(np.median((x if s.column == "x" else z)[np.isin(g, s.groups if s.groups is not None else range(5))])) for s in slots]
    assert got == pytest.approx(want, abs=0)
    inside = selection._inside(df, "g", slots, {i: (-1.0, 1.0) for i in range(len(slots))})
    # explodes before the first aggregation: one, over the columns
    plan = inside._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.rindex("Aggregate"):]
    assert below.count("Generate") == 1
