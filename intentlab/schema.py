"""Session schema, feature lists, declared domains and fixed values.

Everything here is plain data; the operators import it.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values (must equal the reference for equal results) -------------

NUMERIC_FEATURES = [
    "Administrative",
    "Administrative_Duration",
    "Informational",
    "Informational_Duration",
    "ProductRelated",
    "ProductRelated_Duration",
    "BounceRates",
    "ExitRates",
    "PageValues",
    "SpecialDay",
]

CATEGORICAL_FEATURES = [
    "Month",
    "VisitorType",
    "OperatingSystems",
    "Browser",
    "Region",
    "TrafficType",
    "Weekend",
]

TARGET = "Revenue"
ALL_FEATURES = NUMERIC_FEATURES + CATEGORICAL_FEATURES
KEY = "session_id"

# Calendar order used by the explorer; months off this list sort last.
MONTH_ORDER = ["Feb", "Mar", "May", "June", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]

# Named feature groups that can be excluded together.
FEATURE_GROUPS = {
    "Technical": ["OperatingSystems", "Browser", "Region", "TrafficType"],
    "Engagement": ["BounceRates", "ExitRates", "PageValues"],
}

INTEGER_COLUMNS = [
    "Administrative",
    "Informational",
    "ProductRelated",
    "OperatingSystems",
    "Browser",
    "Region",
    "TrafficType",
]

# Declared domains: column -> (lower, upper, default); None = unbounded.
DOMAINS = {
    "Administrative": (0, None, 0),
    "Administrative_Duration": (0.0, None, 0.0),
    "Informational": (0, None, 0),
    "Informational_Duration": (0.0, None, 0.0),
    "ProductRelated": (0, None, 0),
    "ProductRelated_Duration": (0.0, None, 0.0),
    "BounceRates": (0.0, 1.0, 0.0),
    "ExitRates": (0.0, 1.0, 0.0),
    "PageValues": (0.0, None, 0.0),
    "SpecialDay": (0.0, 1.0, 0.0),
    "Month": (None, None, "Nov"),
    "OperatingSystems": (1, None, 2),
    "Browser": (1, None, 2),
    "Region": (1, None, 1),
    "TrafficType": (1, None, 2),
    "VisitorType": (None, None, "Returning_Visitor"),
    "Weekend": (None, None, False),
}

# Texts accepted as a true Weekend flag.
WEEKEND_TRUE_TEXTS = ["True", "true", "1"]

# Training constants.
RANDOM_STATE = 42
TEST_SIZE = 0.20
CV_FOLDS = 5
INTERVENTION_THRESHOLD = 0.30
MIN_TRAINING_ROWS = 500

# Threshold configuration defaults: scoring and training differ in upper.
SCORING_THRESHOLD = {"mode": "lower", "lower": 0.30, "upper": 0.70}
TRAINING_THRESHOLD = {"mode": "lower", "lower": 0.30, "upper": 1.0}

# Confidence buckets on |p - 0.5| (strict comparisons).
CONFIDENCE_HIGH_GAP = 0.35
CONFIDENCE_MEDIUM_GAP = 0.15

# Purchase-rate warning bounds.
PURCHASE_RATE_LOW = 0.01
PURCHASE_RATE_HIGH = 0.70

# Model defaults (hyperparameters per model name).
MODEL_DEFAULTS = {
    "LR_baseline": {"C": 1.0, "solver": "lbfgs"},
    "DT_medium": {"max_depth": 8, "min_samples_leaf": 10, "criterion": "gini"},
    "RF_baseline": {"n_estimators": 200, "max_depth": 12, "max_features": "sqrt"},
    "XGBoost": {
        "n_estimators": 200,
        "learning_rate": 0.05,
        "max_depth": 4,
        "subsample": 0.8,
        "colsample_bytree": 0.8,
        "scale_pos_weight": 5,
    },
}

# Additive purchase-propensity rule (engagement tiers low/medium/high).
SCORECARD = {
    "tier_bounds": (4, 7),  # ProductRelated < 4 low, < 7 medium, else high
    "tier_base": (0.02, 0.12, 0.52),
    "returning": 0.04,
    "new": -0.02,
    "page_value_scale": 200.0,
    "page_value_weight": 0.25,
    "bounce_weight": 0.15,
    "weekend": 0.01,
    "special_day_weight": 0.04,
    "holiday": 0.05,
    "holiday_months": ["Nov", "Dec"],
    "clip": (0.01, 0.95),
}

# Extreme-engagement outlier bounds.
OUTLIER_BOUNDS = {"ProductRelated": 150, "ProductRelated_Duration": 8000.0, "PageValues": 80.0}

# Clip bounds and decimal places of the session columns.
CLIP_ROUND = {
    "Administrative": (0, 20, None),
    "Informational": (0, 10, None),
    "ProductRelated": (1, 200, None),
    "Administrative_Duration": (0.0, 3000.0, 2),
    "Informational_Duration": (0.0, 2000.0, 2),
    "ProductRelated_Duration": (0.0, 10000.0, 2),
    "BounceRates": (0.0, 1.0, 6),
    "ExitRates": (0.0, 1.0, 6),
    "PageValues": (None, None, 2),
    "SpecialDay": (None, None, 2),
}

# --- Spark schema ----------------------------------------------------------

_INT = T.IntegerType()
_DBL = T.DoubleType()
_STR = T.StringType()


def _feature_type(name: str) -> T.DataType:
    if name in INTEGER_COLUMNS:
        return _INT
    if name in ("Month", "VisitorType"):
        return _STR
    if name == "Weekend":
        return T.BooleanType()
    return _DBL


SESSION_FIELDS = [T.StructField(c, _feature_type(c), True) for c in ALL_FEATURES]

#: 17 features + target (file layout of the session CSV / JSON).
SESSION_SCHEMA = T.StructType(SESSION_FIELDS + [T.StructField(TARGET, T.BooleanType(), True)])

#: key + 17 features + target (the table layout used throughout).
KEYED_SESSION_SCHEMA = T.StructType(
    [T.StructField(KEY, T.LongType(), False)] + SESSION_FIELDS + [T.StructField(TARGET, T.BooleanType(), True)]
)

#: One request object: features only.
REQUEST_SCHEMA = T.StructType([T.StructField(KEY, T.LongType(), True)] + SESSION_FIELDS)

BUSINESS_COLUMNS = ALL_FEATURES + [TARGET]
