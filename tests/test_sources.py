"""Sources, stamps and fingerprints."""

import datetime as dt
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from intentlab import schema as S
from intentlab.config import scratch_path
from intentlab.sources import files
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL


def test_first_two_orders_of_a_customer_with_a_third_of_all(spark):
    """The second order by (date, key) decides; the row limit is applied before the shuffle too."""
    from intentlab.sources.tables import customer_facts
    orders = spark.range(3000).selectExpr("id as o_orderkey", "if(id % 3 = 0, 0, id % 100 + 1) as o_custkey",
                                          "timestamp_seconds((id * 7919) % 50 * 86400) as o_orderdate")
    customer = spark.range(102).selectExpr("id as c_custkey", "id as c_nationkey", "'x' as c_mktsegment")
    got = customer_facts(orders, customer)
    by = {}
    for r in orders.collect():
        by.setdefault(r.o_custkey, []).append((r.o_orderdate, r.o_orderkey))
    for r in got.collect():
        own = sorted(by.get(r.c_custkey, []))
        assert (r.second_date, r.second_key) == (own[1] if len(own) > 1 else (None, None))
    plan = got._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 2



def test_table_fingerprint_ignores_row_order_and_partitioning(spark):
    s = load_sessions(spark, SF_SMALL)
    a = files.table_fingerprint(s).first()
    b = files.table_fingerprint(s.repartition(7).orderBy(F.rand(3))).first()
    c = files.table_fingerprint(s.where(F.col(S.KEY) != 1)).first()
    assert a == b and a != c


def test_table_fingerprint_sees_a_change_in_any_column(spark):
    from intentlab.plans.catalog import _FP_COLS
    s = load_sessions(spark, SF_SMALL)
    whole = files.table_fingerprint(s, _FP_COLS).first()
    assert len(_FP_COLS) == 19
    for c in _FP_COLS:
        kind = dict(s.dtypes)[c]
        other = {"boolean": ~F.col(c), "string": F.concat(F.col(c), F.lit("x"))}.get(kind, F.col(c) + 1)
        changed = s.withColumn(c, F.when((F.col(S.KEY) == 1) & F.col(c).isNotNull(), other.cast(kind)).when(F.col(S.KEY) != 1, F.col(c)))
        assert files.table_fingerprint(changed, _FP_COLS).first() != whole, c


def test_csv_and_json_round_trip(spark):
    s = load_sessions(spark, SF_SMALL)
    p_csv, p_json = scratch_path(spark, "rt-csv"), scratch_path(spark, "rt-json")
    files.write_sessions_csv(s, p_csv)
    back = files.read_sessions_csv(spark, p_csv)
    assert back.exceptAll(s).count() == 0 and s.exceptAll(back).count() == 0
    files.write_sessions_json(s.drop(S.TARGET).drop("Month"), p_json)  # a missing key reads as null
    j = files.read_sessions_json(spark, p_json)
    assert j.where(F.col("Month").isNotNull()).count() == 0 and j.count() == s.count()


def test_require_columns_raises(spark):
    s = load_sessions(spark, SF_SMALL).drop("Browser")
    try:
        files.require_columns(s)
    except files.MissingColumnsError as e:
        assert "Browser" in str(e)
    else:
        raise AssertionError("expected MissingColumnsError")


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "hot"]), st.integers(-3, 3)), min_size=1, max_size=60))
def test_prefix_sums_property(spark, rows):
    from intentlab.operators.ranking import prefix_sums
    data = [(i, g, float(v), 1) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "id long, g string, v double, one int")
    got = {r.id: r.one_cum for r in prefix_sums(df, ["v", "id"], ["one"], by=["g"], n_buckets=4).collect()}
    for i, g, v, _ in data:
        want = sum(1 for j, g2, v2, _ in data if g2 == g and (v2, j) <= (v, i))
        assert got[i] == want
