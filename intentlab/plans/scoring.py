"""Batch scoring of an uploaded session file, end to end.

read text cells -> intake (P5/P6/P8: casts, defaults, problems) -> score (scorecard or a
fitted PipelineModel) -> decision columns (M13) -> scored file (S4) and
the summaries shown beside it (A19-A21, A15-A18). One pipelined stage up
to the sink; the summaries are separate aggregations over the written
result, so the scoring itself runs once. No batch-size cap.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..config import materialize
from ..functions import columns as C
from ..operators import decide, intake, models
from ..sources import files


@dataclass
class ScoringResult:
    scored: DataFrame       # the written scored rows, read back
    rejected: DataFrame     # rows with unreadable or out-of-range cells, with the columns and the problems
    summary: DataFrame      # A19
    wasted: DataFrame       # A20 + A21
    histogram: DataFrame    # A15
    sensitivity: DataFrame  # A16
    confidence: DataFrame   # A17
    box: DataFrame          # A18


def score_sessions(sessions: DataFrame, model: PipelineModel | None = None, threshold: dict | None = None,
                   model_name: str = "scorecard") -> DataFrame:
    """M13 over a session frame: decision record per session, features kept."""
    if model is None:
        with_p = sessions.withColumn("p", C.scorecard())
    else:
        with_p = models.score(model, sessions)
    return decide.with_decisions(with_p, threshold=threshold, model_name=model_name,
                                 keep=[S.KEY, *S.ALL_FEATURES])


def score_file(spark: SparkSession, input_csv: str, output_dir: str, model: PipelineModel | None = None,
               threshold: dict | None = None, model_name: str = "scorecard") -> ScoringResult:
    raw = intake.cells_from_csv(spark, input_csv)  # text cells, as uploaded
    files.require_columns(raw, S.ALL_FEATURES)
    keyed = raw if S.KEY in raw.columns else raw.withColumn(S.KEY, F.monotonically_increasing_id().cast("string"))
    # written once: keys stay stable and the summaries read the stored scores
    checked = materialize(intake.typed(keyed.select(S.KEY, *S.ALL_FEATURES)), "scoring-input")
    scored = materialize(score_sessions(intake.accepted(checked), model, threshold, model_name), "scoring-output")
    files.write_scored_csv(scored.withColumn("prediction", C.prediction_label("prediction")), output_dir)
    return ScoringResult(
        scored=scored,
        rejected=checked.where(~F.col("accepted")).select(S.KEY, F.col("problems.column").alias("violations"), "problems"),
        summary=decide.batch_summary(scored),
        wasted=decide.expected_wasted_rate(scored),
        histogram=decide.score_histogram(scored),
        sensitivity=decide.threshold_sensitivity(scored),
        confidence=decide.confidence_breakdown(scored),
        box=decide.score_box_stats(scored),
    )


class RequestRejected(ValueError):
    """A request had no sessions, or sessions that cannot be read or lie outside the declared domains.

    ``rejected`` holds all problems as a DataFrame (None for an empty request); the message names the first ones.
    """

    def __init__(self, message: str, rejected: DataFrame | None = None):
        super().__init__(message)
        self.rejected = rejected


def score_request(spark: SparkSession, sessions: list[dict], model: PipelineModel | None = None,
                  threshold: dict | None = None, model_name: str = "scorecard") -> DataFrame:
    """The request path (single session or a batch of session objects).

    The objects go through the same intake as files and streams: missing keys take the declared
    defaults, unknown keys are ignored, Weekend accepts a boolean or the texts of P5, counts and codes are
    truncated to int (P6); sessions without a key are numbered. Sessions that cannot be read or lie outside the declared
    ranges reject the request, and so does an empty one. No batch-size cap. The payload is
    driver-side by nature (it arrives with the request); everything after
    ``createDataFrame`` runs as Spark expressions.
    """
    if not sessions:
        raise RequestRejected("sessions list must not be empty")
    rows = [(json.dumps({S.KEY: i, **s}, default=str),) for i, s in enumerate(sessions)]
    # written once, so that the cells' expressions are not repeated in what follows
    checked = materialize(intake.typed(intake.cells_from_json(spark.createDataFrame(rows, "value string"))), "request")
    bad = intake.rejected(checked)
    first = bad.limit(6).collect()  # for the message only; the exception carries all
    if first:
        named = "; ".join(f"session {r[S.KEY]}: {r['column']} {r['reason']} ({r['text']})" for r in first[:5])
        raise RequestRejected(named + ("; and more" if len(first) > 5 else ""), bad)
    return score_sessions(intake.accepted(checked), model, threshold, model_name)
