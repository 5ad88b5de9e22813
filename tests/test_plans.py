"""Explorer panels (E3) and the request path (single/batch session objects)."""

import pytest

from intentlab.plans.explorer import explorer_panels
from intentlab.plans.scoring import RequestRejected, score_request
from intentlab.sources.tables import load_sessions

from conftest import SF_SMALL

EXAMPLE = {"Administrative": 5, "Administrative_Duration": 81.5, "Informational": 1, "Informational_Duration": 12.25,
           "ProductRelated": 31, "ProductRelated_Duration": 977.0, "BounceRates": 0.01, "ExitRates": 0.03,
           "PageValues": 22.0, "SpecialDay": 0.0, "Month": "Nov", "OperatingSystems": 3, "Browser": 4, "Region": 6,
           "TrafficType": 1, "VisitorType": "Returning_Visitor", "Weekend": False}


def test_explorer_panels_match_direct_aggregates(spark):
    s = load_sessions(spark, SF_SMALL)
    panels = explorer_panels(s)
    kpi = panels["kpi_summary"].first()
    assert kpi.sessions == s.count() and kpi.purchases + kpi.non_purchases == kpi.sessions
    assert panels["random_sample_n"].count() == min(2000, kpi.sessions)
    assert panels["validation_report"].first().passed


def test_score_request_example_defaults_and_rejections(spark):
    out = score_request(spark, [EXAMPLE, {"ProductRelated": 1, "Weekend": "true", "unknown": 5}]).orderBy("session_id")
    rows = out.collect()
    # high tier .52 + returning .04 + 22/200*.25 - .01*.15 + Nov .05
    want = 0.52 + 0.04 + 22.0 / 200 * 0.25 - 0.01 * 0.15 + 0.05
    assert rows[0].purchase_probability == round(want, 4) and rows[0].confidence == "Low"
    assert rows[1].Month == "Nov" and rows[1].Weekend is True and rows[1].VisitorType == "Returning_Visitor"
    with pytest.raises(RequestRejected):
        score_request(spark, [])
    with pytest.raises(RequestRejected):
        score_request(spark, [{**EXAMPLE, "BounceRates": 1.5}])
