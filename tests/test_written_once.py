"""Rows that several passes read are derived once."""

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from intentlab.operators import models, split


def _counted(spark, column):
    """The column through a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def same(x):
        calls.add(1)
        return x
    return F.udf(same, "long")(column), calls


def test_split_derives_its_rows_once(spark):
    key, calls = _counted(spark, F.col("id"))
    rows = spark.range(500).select(key.alias("session_id")).withColumn("label", (F.col("session_id") % 5 == 0).cast("int"))
    got = split.assign_split(rows, "label").groupBy("label").agg(F.count("*"), F.sum(F.col("is_test").cast("int"))).collect()
    assert sorted(map(tuple, got)) == [(0, 400, 80), (1, 100, 20)]
    assert calls.value == 500


def test_logistic_derives_its_features_once(spark):
    x, calls = _counted(spark, F.col("id"))
    rows = spark.range(300).select(x.alias("x")).select(
        array_to_vector(F.array((F.col("x") / 300), F.sin("x"))).alias("features"), (F.col("x") > 150).cast("int").alias("label"), F.lit(1.0).alias("weight"))
    model = models.PenalisedLogistic(C=1.0).fit(rows)
    assert calls.value == 300 and model.coefficients[0] > 0
