"""The dataset explorer — one session table, written once, every panel an aggregation over it.

The reference caches the loaded table in the process and draws each panel
from it; here the table is written to the shared folder once (a lineage
cut that every executor can read) and each panel is one lazy aggregation,
so a dashboard refresh runs each panel as its own small job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..config import materialize
from ..operators import explore, quality


def explorer_panels(sessions: DataFrame, write_once: bool = True) -> dict[str, DataFrame]:
    """Panels A10-A14 and A29, the samples O3/O4, and the validation report A9."""
    base = materialize(sessions, "explorer-sessions") if write_once else sessions
    return {
        "kpi_summary": explore.kpi_summary(base),
        "purchase_rate_by_month": explore.purchase_rate_by_month(base),
        "sessions_by_visitor_type": explore.sessions_by_visitor_type(base),
        "sessions_by_weekend": explore.sessions_by_weekend(base),
        "page_value_histogram": explore.page_value_histogram(base),
        "batch_profile": explore.batch_profile(base),
        "head_sample": explore.head_sample(base),
        "random_sample_n": explore.random_sample_n(base),
        "validation_report": quality.report_flat(quality.validation_report(base.drop("session_id"))),
    }
