"""E2 batch scoring plan: uploaded CSV -> domains -> decisions -> file + summaries."""

from pyspark.sql import functions as F

from intentlab import schema as S
from intentlab.config import scratch_path
from intentlab.functions import columns as C
from intentlab.operators import prepare
from intentlab.plans.scoring import score_file
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL


def test_score_file_end_to_end(spark):
    s = load_sessions(spark, SF_SMALL)
    upload = s.select(
        S.KEY, *[c for c in S.ALL_FEATURES if c not in ("Weekend", "BounceRates")],
        # two out-of-domain rows are rejected; Weekend arrives as text
        F.when(F.col(S.KEY).isin(1, 2), F.lit(1.5)).otherwise(F.col("BounceRates")).alias("BounceRates"),
        F.initcap(F.col("Weekend").cast("string")).alias("Weekend"),
    )
    path_in, path_out = scratch_path(spark, "upload"), scratch_path(spark, "scored")
    upload.write.option("header", True).csv(path_in)
    res = score_file(spark, path_in, path_out)
    n_rej = res.rejected.count()
    assert n_rej == s.where(F.col(S.KEY).isin(1, 2)).count()
    total = res.summary.first().total_sessions
    assert total == s.count() - n_rej
    want = prepare.domain_validate_rows(s.drop(S.TARGET).where(~F.col(S.KEY).isin(1, 2)))  # request defaults
    want = want.select(S.KEY, F.round(C.scorecard(), 4).alias("pp"))
    got = res.scored.select(S.KEY, F.col("purchase_probability").alias("pp"))
    assert got.exceptAll(want).count() == 0
    assert spark.read.option("header", True).csv(path_out).count() == total
    assert res.sensitivity.count() == 19
