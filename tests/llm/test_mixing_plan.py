"""The mixing stage of the pipeline: what the driver plans and compiles stays short."""

import corpus_pipeline
from intentlab.config import materialize
from intentlab.llm import mixing


def test_mixing_stage_has_a_short_plan_and_the_right_copies(spark):
    rows = [(i, f"word{i} " * (i % 7 + 1), "en", None if i % 5 == 0 else f"s{i % 3}", 3) for i in range(60)] + [(3, "word3 " * 4, "en", "s0", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = corpus_pipeline.mix_sources(spark, docs, "")
    plan = mixed._jdf.queryExecution().executedPlan().toString()
    # the stage joins two written tables and numbers rows of equal id; it held the mix twice, with 41 windows
    assert plan.count("Window [") + plan.count("Window(") <= 3 and plan.count("Exchange") < 20
    got = [tuple(r) for r in mixed.collect()]
    assert set(got) <= set(rows) and max(got.count(r) for r in rows) <= 2 * 2 and len(got) > 60


def test_targets_and_cuts_are_joined_no_more_than_needed(spark, monkeypatch):
    plans = {}

    def written(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return materialize(df, name)
    monkeypatch.setattr(mixing, "materialize", written)
    rows = [(i, "w " * (i % 9), [None, "a", "b", "c"][i % 4]) for i in range(200)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert got.count() == 200
    # once the whole copies with their targets, then each cut reads the rows beside the cut before it
    assert sum(p.count("Join ") for p in plans["mix-targets"]) == 0
    assert [p.count("Join ") for p in plans["mix-cut"]] == [1] * mixing.LEVELS
