"""Champion and challenger as saved models (S7, J5): published by role, loaded with fallback, scored in one pass.

The alias table is append-only (``sources.versioned``): publishing appends one version with all roles, so a
reader sees the old pair or the new one, never a mixture. Models are saved pipelines under paths of their own.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import columns as C
from ..sources import versioned
from . import models

CHAMPION, CHALLENGER = "champion", "challenger"
ALIAS_SCHEMA = "role string, model_type string, run_id string, model_path string"


def publish(spark: SparkSession, path: str, roles: DataFrame, model_dir: str) -> int:
    """Appends the roles (role, model_type, run_id; at most two rows) whose models lie at ``model_dir``/run_id; returns the version."""
    rows = roles.select("role", "model_type", "run_id", F.concat(F.lit(f"{model_dir}/"), "run_id").alias("model_path"))
    return versioned.append(rows.coalesce(1), path)


def current(spark: SparkSession, path: str, version: int | None = None) -> dict[str, dict]:
    """The roles of the newest version (or of ``version``); empty before the first."""
    rows = versioned.read(spark, path, ALIAS_SCHEMA, version)
    newest = rows.agg(F.max(versioned.VERSION)).first()[0]
    return {r["role"]: r.asDict() for r in rows.where(F.col(versioned.VERSION) == newest).collect()}  # at most two rows


def load(spark: SparkSession, path: str, version: int | None = None) -> dict[str, PipelineModel]:
    """The models by role; no champion is an error."""
    found = current(spark, path, version)
    if CHAMPION not in found:
        raise LookupError("no champion is published")
    return {role: PipelineModel.load(r["model_path"]) for role, r in found.items()}


def chosen(loaded: dict, wanted: str = CHAMPION):
    """The wanted role and its model; the champion where that role is not filled."""
    role = wanted if wanted in loaded else CHAMPION
    return role, loaded[role]


def score_by_role(sessions: DataFrame, loaded: dict) -> DataFrame:
    """The sessions with ``scores``, a map from role to p: both models add columns to the same rows, without a join."""
    out = sessions
    for role, model in loaded.items():
        out = models.score(model, out).select(*out.columns, F.col("p").alias(f"_p_{role}"))
    scores = F.create_map(*[x for role in loaded for x in (F.lit(role), F.col(f"_p_{role}"))])
    return out.withColumn("scores", scores).drop(*[f"_p_{role}" for role in loaded])


def compare(sessions: DataFrame, loaded: dict, threshold: dict | None = None) -> DataFrame:
    """J5 on fitted models: sessions per pair of decisions; the challenger's is null where there is none."""
    t = {**S.SCORING_THRESHOLD, **(threshold or {})}
    flags = [C.intervene(F.element_at("scores", F.lit(role)), t["mode"], t["lower"], t["upper"]).alias(f"{role}_intervene")
             for role in (CHAMPION, CHALLENGER)]
    return score_by_role(sessions, loaded).groupBy(*flags).agg(F.count(F.lit(1)).alias("sessions"))
