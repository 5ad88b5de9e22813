"""Distributed ordered operations against brute force on small fixtures."""

import random

import pandas as pd
from pyspark.sql import functions as F

from intentlab.operators import metrics
from intentlab.operators.ranking import exact_quantiles, prefix_sums, row_number_by


def _hot_key_frame(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c"])  # one group holds ~40%
        v = 0.0 if rnd.random() < 0.35 else round(rnd.uniform(-5, 50), 3)  # one value holds ~35%
        rows.append((i, g, v, rnd.randint(0, 1)))
    return spark.createDataFrame(rows, "id long, g string, v double, y int"), pd.DataFrame(rows, columns=["id", "g", "v", "y"])


def test_row_number_matches_sorted_position(spark):
    df, pdf = _hot_key_frame(spark)
    got = row_number_by(df, ["v", "id"], by=["g"], out="rn", n_buckets=16).select("id", "rn").toPandas()
    pdf = pdf.sort_values(["g", "v", "id"])
    pdf["rn"] = pdf.groupby("g").cumcount() + 1
    m = pdf.merge(got, on="id", suffixes=("", "_s"))
    assert len(m) == len(pdf) and (m.rn == m.rn_s).all()


def test_prefix_sums_match_cumsum(spark):
    df, pdf = _hot_key_frame(spark)
    got = prefix_sums(df, ["v", "id"], ["y"], by=["g"], n_buckets=8).select("id", "y_cum").toPandas()
    pdf = pdf.sort_values(["g", "v", "id"])
    pdf["want"] = pdf.groupby("g").y.cumsum()
    m = pdf.merge(got, on="id")
    assert (m.want == m.y_cum).all()


def test_exact_quantiles_match_numpy(spark):
    df, pdf = _hot_key_frame(spark)
    q = exact_quantiles(df.select("g", "v"), "g", "v", (0.25, 0.5, 0.75), n_buckets=8).toPandas().set_index("g")
    for g, part in pdf.groupby("g"):
        vals = part.v.sort_values().to_numpy()
        n = len(vals)
        med = (vals[(n + 1) // 2 - 1] + vals[(n + 2) // 2 - 1]) / 2
        assert q.loc[g, "q_1"] == med
        assert abs(q.loc[g, "q_0"] - part.v.quantile(0.25)) < 1e-9
        assert abs(q.loc[g, "q_2"] - part.v.quantile(0.75)) < 1e-9


def _brute_auc(pairs):
    pos = [p for p, y in pairs if y == 1]
    neg = [p for p, y in pairs if y == 0]
    if not pos or not neg:
        return None
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_auc_equals_pairwise_brute_force_with_ties(spark):
    rnd = random.Random(3)
    rows = [(i, "g1" if i % 3 else "g2", round(rnd.random(), 2), int(rnd.random() < 0.3)) for i in range(600)]
    rows += [(1000 + i, "one_class", 0.5, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "id long, grp string, p double, label int")
    got = {r.grp: r.roc_auc for r in metrics.roc_auc(df, "label", "p", by=["grp"], n_buckets=8).collect()}
    for g in ("g1", "g2"):
        want = _brute_auc([(p, y) for _, gg, p, y in rows if gg == g])
        assert abs(got[g] - want) < 1e-12
    assert got["one_class"] is None


def test_auc_equals_spark_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(5)
    rows = [(round(rnd.random(), 3), float(rnd.random() < 0.2)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "p double, label double")
    ours = metrics.roc_auc(df.withColumn("label", F.col("label").cast("int")), "label", "p").first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0).evaluate(df)
    assert abs(ours - ev) < 1e-9


def test_holdout_evaluation_equals_separate_operators(spark):
    from intentlab.operators import decide, models
    rnd = random.Random(9)
    rows = [(i, round(rnd.random(), 3), int(rnd.random() < 0.3)) for i in range(800)]
    df = spark.createDataFrame(rows, "session_id long, p double, label int").withColumn(
        "prediction", (F.col("p") > 0.5).cast("int"))
    one = models.evaluate_holdout(df).first().asDict()
    cls = metrics.classification_metrics(df).first().asDict()
    cm = metrics.confusion_matrix(df).first().asDict()
    wdr = decide.realised_wasted_rate(df, "p", "label").first().asDict()
    auc = metrics.roc_auc(df, "label", "p").first().roc_auc
    for k, v in {**cls, **cm, **wdr, "roc_auc": auc}.items():
        assert one[k] == v, k
