"""Scoring arriving sessions with Structured Streaming.

T1 is stateless: read new session files, score, add the decision columns,
append to a parquet sink; with the same rows the result equals the batch
result. T2 looks up the dated threshold rows at every micro-batch, so
a threshold change takes effect without restarting the query.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import schema as S
from ..functions import columns as C
from ..operators import decide, intake, registry
from ..sources import versioned


def scorecard_scorer(df: DataFrame) -> DataFrame:
    return df.withColumn("p", C.scorecard())


def read_session_stream(spark: SparkSession, source_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(S.KEYED_SESSION_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(source_dir)


def stream_score_sessions(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                          scorer: Callable[[DataFrame], DataFrame] = scorecard_scorer,
                          threshold: dict | None = None, model_name: str = "scorecard",
                          available_now: bool = True, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Stateless scoring stream into an append-only parquet sink.

    ``max_files_per_trigger`` bounds each micro-batch (``availableNow``
    honours it), so a large backlog is scored in several batches.
    """
    source = read_session_stream(spark, source_dir, max_files_per_trigger)
    decided = decide.with_decisions(scorer(source), threshold=threshold, model_name=model_name)
    w = decided.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir)
    w = w.outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def pinned_threshold(spark: SparkSession, threshold_path: str, sink_dir: str, epoch: int) -> dict:
    """The threshold row of a micro-batch: the one valid at its first run, kept beside the sink for every later run."""
    pin = f"{sink_dir}/_thresholds/{epoch}"
    kept = versioned.read_text(spark, pin)
    if not kept:
        found = registry.valid_threshold(spark, threshold_path, epoch)["version"]
        versioned.create_if_absent(spark, pin, str(found))
        kept = versioned.read_text(spark, pin)
    version = int(kept)
    return registry.valid_threshold(spark, threshold_path, version=version) if version else {**S.SCORING_THRESHOLD, "version": 0}


def stream_with_threshold_reload(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                                 threshold_path: str,
                                 scorer: Callable[[DataFrame], DataFrame] = scorecard_scorer,
                                 model_name: str = "scorecard", available_now: bool = True,
                                 interval: str = "10 seconds") -> StreamingQuery:
    """Every micro-batch is decided by the threshold row (S9) valid at it, while the query runs on.

    The table of thresholds is read at each batch; a batch that runs again after a
    failure keeps the row of its first run and overwrites its own folder.
    """

    def apply(batch: DataFrame, epoch_id: int) -> None:
        t = pinned_threshold(batch.sparkSession, threshold_path, sink_dir, epoch_id)
        out = decide.with_decisions(scorer(batch), threshold=t, model_name=model_name).select(
            "*", F.lit(t["mode"]).alias("threshold_mode"), F.lit(float(t["upper"])).alias("threshold_upper"),
            F.lit(t["version"]).alias("threshold_version"))
        # one folder per epoch, overwritten on replay: a re-run batch is written once
        out.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={epoch_id}")

    q = (read_session_stream(spark, source_dir).writeStream.foreachBatch(apply)
         .option("checkpointLocation", checkpoint_dir))
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime=interval)
    return q.start()


def stream_score_json(spark: SparkSession, source_dir: str, sink_dir: str, rejected_dir: str, checkpoint_dir: str,
                      scorer: Callable[[DataFrame], DataFrame] = scorecard_scorer, threshold: dict | None = None,
                      model_name: str = "scorecard", available_now: bool = True,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """T1 on JSON lines: sessions pass the shared intake; decided ones go to one sink, rejected cells to another.

    Each micro-batch is parsed once and writes one folder in either sink; a batch that runs again overwrites both.
    """
    source = spark.readStream
    if max_files_per_trigger:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)

    def apply(batch: DataFrame, epoch_id: int) -> None:
        checked = intake.typed(intake.cells_from_json(batch)).persist()
        try:
            decided = decide.with_decisions(scorer(intake.accepted(checked)), threshold=threshold, model_name=model_name)
            decided.write.mode("overwrite").parquet(f"{sink_dir}/batch_id={epoch_id}")
            intake.rejected(checked).write.mode("overwrite").parquet(f"{rejected_dir}/batch_id={epoch_id}")
        finally:
            checked.unpersist()

    q = source.text(source_dir).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint_dir)
    q = q.trigger(availableNow=True) if available_now else q.trigger(processingTime="10 seconds")
    return q.start()
