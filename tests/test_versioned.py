"""Optimistic commits, dated thresholds, the shared intake and the hash tree."""

import json
import math
import random
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from intentlab import schema as S
from intentlab.config import materialize, scratch_path
from intentlab.operators import decide, intake, registry
from intentlab.plans.scoring import RequestRejected, score_file, score_request
from intentlab.sources import hashtree, versioned
from intentlab.streaming.scoring import pinned_threshold, stream_score_json, stream_with_threshold_reload
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL


# --- commits -----------------------------------------------------------------------------

def test_one_of_many_creates_a_file(spark):
    path = scratch_path(spark, "created") + "/file"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: versioned.create_if_absent(spark, path, str(i)), range(24)))
    assert won.count(True) == 1 and versioned.read_text(spark, path) == str(won.index(True))
    assert versioned.read_text(spark, path + "-other") is None


def test_concurrent_appends_get_versions_of_their_own(spark):
    path = scratch_path(spark, "versioned")
    assert versioned.read(spark, path, "x long").count() == 0
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda i: (versioned.append(spark.range(i, i + 3).toDF("x"), path), i), range(12)))
    assert sorted(v for v, _ in got) == list(range(1, 13))
    rows = versioned.read(spark, path, "x long")
    assert rows.count() == 36
    for v, i in got:
        assert sorted(r.x for r in rows.where(F.col("commit") == v).collect()) == [i, i + 1, i + 2]
    assert versioned.read(spark, path, "x long", as_of=4).count() == 12


def test_data_without_a_commit_is_not_read(spark):
    path = scratch_path(spark, "versioned")
    versioned.append(spark.range(2).toDF("x"), path)
    spark.range(5).toDF("x").write.parquet(f"{path}/data/{'0' * 32}")  # of a job that died
    assert versioned.read(spark, path, "x long").count() == 2


def _run(spark, run_id, auc, started="2026-01-01"):
    return spark.sql(f"SELECT '{run_id}' run_id, 'LR' run_name, timestamp'{started}' started_at, map('model_type', 'LR') params, "
                     f"map('roc_auc', {auc}D) metrics, map('data_hash', 'h-{run_id}', 'importances', '[]') artifacts")


def test_versions_never_change_later(spark):
    """Also when a run with an earlier start is appended later."""
    path = scratch_path(spark, "runs")

    def numbers():
        runs = registry.model_runs(registry.read_run_log(spark, path))
        return {r.run_id: r.version for r in registry.number_versions(runs).collect()}
    registry.append_runs(_run(spark, "b", 0.8), path)
    registry.append_runs(_run(spark, "c", 0.9), path)
    before = numbers()
    registry.append_runs(_run(spark, "a", 0.7, "2020-01-01"), path)
    assert numbers() == {**before, "a": 3} == {"b": 1, "c": 2, "a": 3}
    kept = {r.run_id: r.artifacts for r in registry.model_runs(registry.read_run_log(spark, path)).collect()}
    assert kept["a"]["data_hash"] == "h-a" and registry.read_run_log(spark, path, as_of=2).count() == 2


# --- thresholds ----------------------------------------------------------------------------

def test_threshold_rows_by_batch(spark):
    path = scratch_path(spark, "thresholds")
    assert registry.valid_threshold(spark, path, 3) == {**S.SCORING_THRESHOLD, "version": 0}
    registry.write_threshold(spark, path, "range", 0.2, 0.6, valid_from=5)
    assert registry.valid_threshold(spark, path, 4)["version"] == 0 and registry.valid_threshold(spark, path, 5)["version"] == 1
    registry.write_threshold(spark, path, "lower", 0.4, 0.7)
    assert [registry.valid_threshold(spark, path, b)["version"] for b in (0, 4, 5, 9)] == [2, 2, 1, 1]
    registry.write_threshold(spark, path, "lower", 0.5, 0.7, valid_from=5)
    assert registry.valid_threshold(spark, path, 9)["lower"] == 0.5
    assert registry.valid_threshold(spark, path)["version"] == 3 and registry.valid_threshold(spark, path, version=1)["upper"] == 0.6


def test_a_batch_that_runs_again_keeps_its_threshold(spark):
    path, sink = scratch_path(spark, "thresholds"), scratch_path(spark, "sink")
    registry.write_threshold(spark, path, "lower", 0.3, 0.7)
    first = pinned_threshold(spark, path, sink, 0)
    registry.write_threshold(spark, path, "lower", 0.6, 0.7)
    assert pinned_threshold(spark, path, sink, 0) == first and pinned_threshold(spark, path, sink, 1)["lower"] == 0.6


def test_threshold_changes_while_the_query_runs(spark):
    src, sink, ckpt, thr = (scratch_path(spark, n) for n in ("src", "sink", "ckpt", "thr"))
    s = load_sessions(spark, SF_SMALL)
    query = None
    try:
        s.where("session_id % 3 = 0").write.mode("append").parquet(src)
        query = stream_with_threshold_reload(spark, src, sink, ckpt, thr, available_now=False, interval="0 seconds")
        query.processAllAvailable()
        for k, mode in ((1, "range"), (2, "lower")):
            registry.write_threshold(spark, thr, mode, 0.25, 0.5)
            s.where(f"session_id % 3 = {k}").write.mode("append").parquet(src)
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    out = spark.read.parquet(sink)
    assert out.count() == s.count()
    got = {(r[0], r.threshold_version, r.threshold_mode, r.intervention_threshold) for r in out.select(
        F.expr("session_id % 3"), "threshold_version", "threshold_mode", "intervention_threshold").distinct().collect()}
    assert got == {(0, 0, "lower", 0.3), (1, 1, "range", 0.25), (2, 2, "lower", 0.25)}


# --- intake --------------------------------------------------------------------------------

SESSIONS = [
    {"session_id": 1, "ProductRelated": 8, "PageValues": 12.5, "Month": "Dec", "Weekend": True, "unknown": [1, 2]},
    {"session_id": 2, "ProductRelated": "7.0", "Weekend": "1", "BounceRates": "NaN", "VisitorType": ""},
    {"session_id": 3, "ProductRelated": "abc", "BounceRates": 1.5},
    {"session_id": 4, "Region": 0, "Browser": 1e12},
    {"session_id": 5},
    {"session_id": 6, "Administrative": -1.0, "Weekend": "yes", "ExitRates": "0,5"},
]
PROBLEMS = {(3, "ProductRelated", "not a whole number in range", "abc"), (3, "BounceRates", "out of range", "1.5"), (4, "Region", "out of range", "0"),
            (4, "Browser", "not a whole number in range", "1.0E12"), (6, "Administrative", "out of range", "-1"), (6, "ExitRates", "not a number", "0,5")}


def _as_csv(path, rows):
    def cell(v):
        return "" if v is None else '"' + str(v) + '"'
    with open(path, "w") as out:
        out.write(",".join(["session_id", *S.ALL_FEATURES]) + "\n")
        for r in rows:
            out.write(",".join(cell(r.get(c)) for c in ["session_id", *S.ALL_FEATURES]) + "\n")


def test_file_stream_and_request_give_equal_records(spark, tmp_path):
    fields = ["session_id", "purchase_probability", "prediction", "intervene", "confidence"]
    src, sink, bad, ckpt = (str(tmp_path / n) for n in ("json", "sink", "bad", "ckpt"))
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.txt").write_text("\n".join([*map(json.dumps, SESSIONS), '{"session_id": 7', "[1]", ""]) + "\n")
    stream_score_json(spark, src, sink, bad, ckpt).awaitTermination()
    streamed = sorted(map(tuple, spark.read.parquet(sink).select(fields).collect()))
    _as_csv(tmp_path / "up.csv", SESSIONS)
    filed = score_file(spark, str(tmp_path / "up.csv"), str(tmp_path / "out"))
    assert sorted(map(tuple, filed.scored.select(fields).collect())) == streamed
    good = [s for s in SESSIONS if s["session_id"] in (1, 2, 5)]
    requested = score_request(spark, good)
    assert sorted(map(tuple, requested.select(fields).collect())) == streamed and len(streamed) == 3
    problems = {tuple(r) for r in spark.read.parquet(bad).select("session_id", "column", "reason", "text").collect()}
    whole = {p for p in problems if p[0] is not None}
    # a number's text is that of its source
    assert {p[:3] for p in whole} == {p[:3] for p in PROBLEMS}
    assert {p[2:] for p in problems - whole} == {("not a session object", t) for t in ('{"session_id": 7', "[1]", "")}
    listed = filed.rejected.select("session_id", F.explode("violations")).collect()
    assert {tuple(r) for r in listed} == {p[:2] for p in PROBLEMS}
    with pytest.raises(RequestRejected) as caught:
        score_request(spark, SESSIONS)
    assert {tuple(r)[:3] for r in caught.value.rejected.select("session_id", "column", "reason").collect()} == {p[:3] for p in PROBLEMS}


def test_quarantine_counts_in_the_same_pass(spark, tmp_path):
    _as_csv(tmp_path / "up.csv", SESSIONS * 3)
    counts = intake.split_csv(spark, str(tmp_path / "up.csv"), str(tmp_path / "good"), str(tmp_path / "bad"))
    assert counts == {"rows": 18, "rejected": 9}
    good = spark.read.parquet(str(tmp_path / "good"))
    assert good.count() == 9 and good.where("session_id = 2").first().ProductRelated == 7
    five = good.where("session_id = 5").first()
    assert all(five[c] == S.DOMAINS[c][2] for c in S.ALL_FEATURES)
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 3 * len(PROBLEMS)


def test_json_stream_that_runs_again_writes_once(spark, tmp_path):
    (tmp_path / "json").mkdir()
    (tmp_path / "json" / "a.txt").write_text("\n".join(map(json.dumps, SESSIONS)))
    for ckpt in ("one", "two"):  # the second checkpoint replays batch 0
        stream_score_json(spark, str(tmp_path / "json"), str(tmp_path / "sink"), str(tmp_path / "bad"), str(tmp_path / ckpt)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "sink")).count() == 3 and spark.read.parquet(str(tmp_path / "bad")).count() == len(PROBLEMS)


# --- hash tree -----------------------------------------------------------------------------

def _exact(x):
    if x == 0:
        return "0"
    m, e = math.frexp(abs(x))
    return ("-" if x < 0 else "") + f"{int(m * 2 ** 53)}e{e - 1}"


def test_exact_text_of_doubles(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1.0, -1.5, 0.1, 5e-324, -2.2250738585072014e-308, 1.7976931348623157e308, 2.0 ** 52, 2.0 ** 53 - 1, 1 - 2 ** -53, 1 + 2 ** -52]
    values += [rng.uniform(-1, 1) * 10.0 ** rng.randint(-300, 300) for _ in range(300)] + [2.0 ** k for k in range(-1074, 1024, 7)]
    values += [math.nextafter(2.0 ** k, 0) for k in range(-1000, 1024, 9)]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select("x", hashtree.exact_text(F.col("x")).alias("t")).collect()
    assert [r.t for r in rows] == [_exact(r.x) for r in rows]
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),), (float("-inf"),)], "x double")
    assert [r.t for r in odd.select(hashtree.exact_text(F.col("x")).alias("t")).collect()] == ["\u0000", "nan", "inf", "-inf"]


def test_the_smallest_change_is_seen_and_located(spark):
    df = spark.range(-3000, 60000, 3).selectExpr("id AS k", "cast(id AS double) / 7 AS x", "cast(id AS string) AS s").unionAll(
        spark.sql("SELECT cast(null AS long), 1.0D, 'no key'"))
    tracked = hashtree.hash_tree(df, "k")
    assert hashtree.differing_ranges(tracked, hashtree.hash_tree(df.repartition(5), "k")).count() == 0
    value = df.where("k = 30003").first().x
    for other in (math.nextafter(value, 0), math.nextafter(value, 1e9)):
        changed = df.withColumn("x", F.when(F.col("k") == 30003, F.lit(other)).otherwise(F.col("x")))
        got = hashtree.differing_ranges(tracked, hashtree.hash_tree(changed, "k")).collect()
        assert [(r.first_key, r.last_key) for r in got] == [(30003 >> 10 << 10, (30003 >> 10 << 10) + 1023)]
    gone = hashtree.differing_ranges(tracked, hashtree.hash_tree(df.where("k <> 0 OR k IS NULL"), "k")).first()
    assert (gone.first_key, gone.tracked_rows - gone.actual_rows) == (0, 1)
    lost = hashtree.differing_ranges(tracked, hashtree.hash_tree(df.where("k IS NOT NULL"), "k")).collect()
    assert [(r.first_key, r.tracked_rows, r.actual_rows) for r in lost] == [(None, 1, 0)]


def test_tree_sums_and_empty_tables(spark):
    df = spark.range(5000).selectExpr("id AS k")
    tree = hashtree.hash_tree(df, "k")
    sums = {r.level: (r.n, r.h) for r in tree.groupBy("level").agg(F.sum("rows").alias("n"), F.sum("hash").alias("h")).collect()}
    assert len(set(sums.values())) == 1 and sums[0][0] == 5000
    none = hashtree.hash_tree(df.where("false"), "k")
    assert [tuple(r) for r in none.collect()] == [(1, 0, 0, 0)]
    assert hashtree.differing_ranges(none, none).count() == 0
    assert hashtree.differing_ranges(none, tree).agg(F.sum("actual_rows")).first()[0] == 5000


def test_decisions_of_a_batch_are_unchanged_by_the_intake(spark):
    s = load_sessions(spark, SF_SMALL)
    cells = s.select(F.col(S.KEY).cast("string"), *[F.col(c).cast("string").alias(c) for c in S.ALL_FEATURES])
    from intentlab.functions import columns as C
    from intentlab.operators.prepare import domain_validate_rows
    a = decide.with_decisions(intake.accepted(materialize(intake.typed(cells), "typed")).withColumn("p", C.scorecard()))
    b = decide.with_decisions(domain_validate_rows(s.drop(S.TARGET)).withColumn("p", C.scorecard()))
    assert a.exceptAll(b).count() == 0 and a.count() == b.count()
