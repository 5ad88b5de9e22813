"""SQL text for an independent engine (DuckDB) over the same parquet tables.

``SESSIONS_CTE`` derives the session table exactly as
``sources.tables.sessions_from_tables`` does; ``SCORED_CTE`` adds the
scorecard probability ``p``. Each oracle query is ``WITH <ctes> <body>``.
Decimal-looking literals are written in E-notation so that both engines
compute in DOUBLE.
"""

from __future__ import annotations

SESSIONS_CTE = """
li AS (
  SELECT l_orderkey,
         count(*) AS n,
         count(CASE WHEN l_returnflag = 'A' THEN 1 END) AS na,
         count(CASE WHEN l_returnflag = 'N' THEN 1 END) AS nn,
         sum(CAST(l_quantity AS BIGINT)) AS q,
         sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) END) AS qa,
         sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) END) AS qn,
         sum(CAST(ROUND(l_discount * 100) AS BIGINT)) AS d,
         sum(CAST(ROUND(l_tax * 100) AS BIGINT)) AS t,
         sum(CAST(ROUND(l_extendedprice * 100) AS BIGINT)) AS k
  FROM lineitem GROUP BY l_orderkey
),
ord AS (
  SELECT o_orderkey, o_custkey, o_orderdate,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn
  FROM orders
),
sessions AS (
  SELECT o.o_orderkey AS session_id,
         CAST(coalesce(na, 0) AS INTEGER) AS Administrative,
         CAST(coalesce(qa, 0) AS DOUBLE) AS Administrative_Duration,
         CAST(coalesce(nn, 0) AS INTEGER) AS Informational,
         CAST(coalesce(qn, 0) AS DOUBLE) AS Informational_Duration,
         CAST(coalesce(n, 0) AS INTEGER) AS ProductRelated,
         CAST(coalesce(q, 0) AS DOUBLE) AS ProductRelated_Duration,
         CAST(d AS DOUBLE) / n / 100 AS BounceRates,
         CAST(d + t AS DOUBLE) / n / 100 AS ExitRates,
         CAST(k AS DOUBLE) / 1000000 AS PageValues,
         CASE WHEN month(o_orderdate) IN (2, 5) AND abs(day(o_orderdate) - 14) < 5
              THEN CAST(5 - abs(day(o_orderdate) - 14) AS DOUBLE) / 5 ELSE 0.0E0 END AS SpecialDay,
         (['Jan','Feb','Mar','Apr','May','June','Jul','Aug','Sep','Oct','Nov','Dec'])[month(o_orderdate)] AS Month,
         CASE WHEN c_mktsegment = 'MACHINERY' AND o.o_orderkey % 3 = 0 THEN 'Other'
              WHEN rn <= 2 THEN 'New_Visitor' ELSE 'Returning_Visitor' END AS VisitorType,
         CAST(1 + o.o_orderkey % 8 AS INTEGER) AS OperatingSystems,
         CAST(1 + o.o_custkey % 13 AS INTEGER) AS Browser,
         CAST(1 + c_nationkey % 9 AS INTEGER) AS Region,
         CAST(1 + o.o_orderkey % 20 AS INTEGER) AS TrafficType,
         dayofweek(o_orderdate) IN (0, 6) AS Weekend,
         (coalesce(k, 0) >= 30000000 AND o.o_orderkey % 10 < 5) OR o.o_orderkey % 29 = 0 AS Revenue
  FROM ord o JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey
)"""

# The additive scorecard (same term order as functions.columns.scorecard).
P_EXPR = """GREATEST(1.0E-2, LEAST(9.5E-1, coalesce(
      CASE WHEN ProductRelated < 4 THEN 2.0E-2 WHEN ProductRelated < 7 THEN 1.2E-1 ELSE 5.2E-1 END
      + CASE WHEN VisitorType = 'Returning_Visitor' THEN 4.0E-2 ELSE 0.0E0 END
      + CASE WHEN VisitorType = 'New_Visitor' THEN -2.0E-2 ELSE 0.0E0 END
      + PageValues / 2.0E2 * 2.5E-1
      - coalesce(BounceRates, 0.0E0) * 1.5E-1
      + CASE WHEN Weekend THEN 1.0E-2 ELSE 0.0E0 END
      + SpecialDay * 4.0E-2
      + CASE WHEN Month IN ('Nov', 'Dec') THEN 5.0E-2 ELSE 0.0E0 END, 1.0E-2)))"""

SCORED_CTE = SESSIONS_CTE + f""",
scored AS (
  SELECT *, {P_EXPR} AS p FROM sessions
)"""

# Seeded hash order used for sampling, the hold-out split and the folds.
HASH_ORDER = "md5(CAST(session_id AS VARCHAR) || ':42'), session_id"


def with_sessions(body: str) -> str:
    return "WITH " + SESSIONS_CTE + "\n" + body


def with_scored(body: str, extra_ctes: str = "") -> str:
    extra = ("," + extra_ctes) if extra_ctes else ""
    return "WITH " + SCORED_CTE + extra + "\n" + body


def scorecard_sql(excluded: tuple[str, ...] = ()) -> str:
    """The scorecard with the terms of excluded features left out (as functions.columns.scorecard)."""
    if "ProductRelated" in excluded:
        raw = "2.0E-2"
    else:
        raw = "CASE WHEN ProductRelated < 4 THEN 2.0E-2 WHEN ProductRelated < 7 THEN 1.2E-1 ELSE 5.2E-1 END"
    if "VisitorType" not in excluded:
        raw += " + CASE WHEN VisitorType = 'Returning_Visitor' THEN 4.0E-2 ELSE 0.0E0 END"
        raw += " + CASE WHEN VisitorType = 'New_Visitor' THEN -2.0E-2 ELSE 0.0E0 END"
    if "PageValues" not in excluded:
        raw += " + PageValues / 2.0E2 * 2.5E-1"
    if "BounceRates" not in excluded:
        raw += " - coalesce(BounceRates, 0.0E0) * 1.5E-1"
    if "Weekend" not in excluded:
        raw += " + CASE WHEN Weekend THEN 1.0E-2 ELSE 0.0E0 END"
    if "SpecialDay" not in excluded:
        raw += " + SpecialDay * 4.0E-2"
    if "Month" not in excluded:
        raw += " + CASE WHEN Month IN ('Nov', 'Dec') THEN 5.0E-2 ELSE 0.0E0 END"
    return f"GREATEST(1.0E-2, LEAST(9.5E-1, coalesce({raw}, 1.0E-2)))"
