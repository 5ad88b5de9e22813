"""Exact stratified hold-out and folds."""

from pyspark.sql import functions as F

from intentlab.operators import split


def _labeled(spark, n=1003, pos_every=7):
    return spark.createDataFrame([(i, int(i % pos_every == 0)) for i in range(n)], "session_id long, label int")


def test_test_share_per_class_is_exact(spark):
    df = _labeled(spark)
    s = split.assign_split(df, "label")
    got = {(r.label, r.is_test): r.n for r in s.groupBy("label", "is_test").agg(F.count("*").alias("n")).collect()}
    n1 = len([i for i in range(1003) if i % 7 == 0])
    n0 = 1003 - n1
    assert got[(1, True)] == round(0.2 * n1) and got[(0, True)] == round(0.2 * n0)


def test_folds_disjoint_complete_balanced(spark):
    s = split.assign_split(_labeled(spark), "label")
    train = s.where(~F.col("is_test"))
    assert train.where(F.col("fold").isNull()).count() == 0
    per = {(r.label, r.fold): r.n for r in train.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    for lab in (0, 1):
        sizes = [per.get((lab, k), 0) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1
    assert s.where(F.col("is_test")).where(F.col("fold").isNotNull()).count() == 0


def test_split_is_deterministic_under_repartitioning(spark):
    df = _labeled(spark)
    a = split.assign_split(df, "label").where("is_test").select("session_id")
    b = split.assign_split(df.repartition(13), "label").where("is_test").select("session_id")
    assert sorted(r[0] for r in a.collect()) == sorted(r[0] for r in b.collect())


def test_balanced_weights(spark):
    w = split.class_balance_weights(_labeled(spark, 100, 4), "label")
    got = {r.label: r.weight for r in w.select("label", "weight").distinct().collect()}
    assert got == {0: 100 / (2 * 75), 1: 100 / (2 * 25)}
