"""Fixed values that must equal the behaviour being reproduced.

Everything here is a plain value (thresholds, code lists, texts).  Logic lives
in the operator modules; they import these names so that one table of values
drives both the Spark operators and the SQL oracle strings.
"""

from __future__ import annotations

# --------------------------------------------------------------------------
# FIXED VALUES — policy rules, bands and texts of the scorecard
# --------------------------------------------------------------------------

SANCTIONED_COUNTRIES = ["IR", "KP", "SY", "SD", "CU"]

DEFAULT_COUNTRY = "US"
DEFAULT_ACCOUNT_AGE_DAYS = 365
DEFAULT_SENDER_ID = "ACC-1102"
DEFAULT_RECEIVER_ID = "ACC-8839"

VOLUME_LIMIT = 150000.0          # rule V02: amount strictly above
NEW_ACCOUNT_MAX_AGE = 7          # rule A03: age strictly below
NEW_ACCOUNT_AMOUNT = 25000.0     # rule A03: or amount strictly above

RULE_G01_ID = "RULE-G01-SANCTION"
RULE_G01_NAME_PREFIX = "OFAC Sanction Match: "
RULE_G01_REASON = "Entity sequence initiated or routed involving flagged OFAC target sanction codes."
RULE_V02_ID = "RULE-V02-OUTRAGEOUS-AMOUNT"
RULE_V02_NAME = "Velvet Volume Overflow"
RULE_V02_REASON = "Single transactional volume ${amount} exceeds standard velocity verification baseline."
RULE_A03_ID = "RULE-A03-NEW-ACCOUNT-VELOCITY"
RULE_A03_NAME = "Swift New Account Outflow"
RULE_A03_REASON = "Operational age {age} days paired with cross-border transfer signals."
RULE_U04_ID = "RULE-U04-ISOLATION-FOREST-ANOMALY"
RULE_U04_NAME = "Isolation Forest Outlier Exception"
RULE_U04_REASON = "Unsupervised Isolation Forest algorithm detected high-dimensional transactional outliers."

# rule id -> (trigger score, tier, severity)
RULE_SCORES = {
    RULE_G01_ID: (99, "Critical", "Critical"),
    RULE_V02_ID: (90, "Critical", "Critical"),
    RULE_A03_ID: (75, "High", "High"),
    RULE_U04_ID: (65, "High", "High"),
}

# engine bands on the 0..100 integer score: upper bounds of Low, Medium, High
ENGINE_BANDS = [(25, "Low", "Approve"), (50, "Medium", "Review"), (75, "High", "Escalate"), (100, "Critical", "Block")]

ENGINE_VERSION = "v1.0.0-beta"
PROXY_MODEL_NAME = "MOCK_SCORING_PROXY"

PREDICTION_FALLBACK = 0.12       # probability when the classifier fails
CLASS_THRESHOLD = 0.50
ML_WEIGHT = 0.8                  # blend: 0.8 * ML risk + 0.2 * anomaly risk
ANOMALY_WEIGHT = 0.2
ALERT_THRESHOLD = 25             # alert when final score is strictly above

# anomaly-score bounds shipped with the trained state
ANOMALY_SCORE_MIN = -0.17512696395350574
ANOMALY_SCORE_MAX = 0.17432510860290407

# regulatory features the proxy scorer reacts to and that training force-includes
HIGHLIGHTED_FEATURES = [
    "F115", "F321", "F527", "F531", "F670", "F1692", "F2082", "F2122", "F2582",
    "F2678", "F2737", "F2956", "F3043", "F3836", "F3887", "F3889", "F3891", "F3894",
]

TARGET_COLUMN = "F3924"
KNOWN_LEAKAGE_COLUMNS = ["F3912", "F3920", "F3921", "F3922", "F3923"]
LEAK_NAME_MARKERS = ["leak", "target", "label", "derived", "output", "y"]

# alert texts
ALERT_STATUSES = ["Open", "Investigating", "Escalated", "Closed"]
SEVERITIES = ["Critical", "High", "Medium", "Low"]
SYSTEM_OPERATOR = "System Agent"
ADMIN_OPERATOR = "Admin (Operator)"
AUTO_EVAL_ACTION = "Automatic Risk Score Evaluation"
UNASSIGNED = "Unassigned"
REASON_TRIGGERED = " Risk Score Card triggered."
REASON_RULES = " Rule Violations detected: "
REASON_DRIVERS = " Driven by high ML features variance: "
MANUAL_SYNC_OPERATOR = "Manual Synchronizer"
MANUAL_SYNC_ACTION = "Injected Alert"
MANUAL_DEFAULT_REASON = "Manual external legacy rule sync ingestion."
MANUAL_DEFAULT_ACCOUNT = "ACC-UNKN"
ALERT_LIST_DEFAULT_LIMIT = 1000
ALERT_LIST_MAX_LIMIT = 2000
PAGE_SIZE = 5

# attribution
WATERFALL_TOP_K = 8
DRIVER_MIN_ABS = 1e-4
DRIVER_TOP_N = 3
ATTR_ZERO_SHIFT = 1e-7
ATTR_SCALE_MIN = 1e-4
BASE_STEP_LABEL = "Base Expectation (Expected Value)"
FINAL_STEP_LABEL = "Final Risk Prediction Probability"

# governance thresholds
MISSING_THRESHOLD = 0.50
VARIANCE_THRESHOLD = 0.01
LEAKAGE_CORRELATION = 0.999
COLLINEAR_THRESHOLD = 0.95
MI_NEIGHBOURS = 3

# ISO codes used by the derived transaction fixture: index = nation key
FIXTURE_COUNTRIES = [
    "US", "GB", "DE", "FR", "IR", "CN", "IN", "BR", "KP", "JP", "CA", "AU", "SY",
    "MX", "ZA", "SD", "IT", "ES", "CU", "KR", "NL", "SE", "CH", "SG", "AE",
]

# FIXED VALUES — training order
TRAINING_LEAKAGE_CORRELATION = 0.99
TRAINING_MI_TOP = 40
RFE_STEP = 0.15
RFE_MIN_FEATURES = 12
POSITIVE_CLASS_WEIGHT = 111.0

# FIXED VALUES — friendly names of known features (feature catalog lookup)
FEATURE_DESCRIPTIONS = {
    "F5": "Velocity of Incoming Transfers (24h)",
    "F9": "Ratio of External Transfers",
    "F11": "Account Age in Days",
    "F24": "Device IP Risk Score",
    "F26": "Distance from Typical Location",
    "F40": "Count of Linked/Associated Profiles",
    "F43": "Cross-Border Transaction Ratio",
    "F46": "Velocity Change Ratio (7d)",
    "F49": "High-Risk Hosting ASN Match",
    "F52": "Deposit Frequency Deviation",
    "F55": "Night-time Transfer Ratio",
    "F60": "Multiple Beneficiary Count",
    "F65": "Layering Chain Length",
}

# FIXED VALUES — backfill alert texts and times
BACKFILL_TIMESTAMP = "2026-05-30T14:00:00Z"
BACKFILL_OPEN_TIME = "14:00:00 UTC"
BACKFILL_CLOSE_TIME = "15:00:00 UTC"
BACKFILL_CLOSE_ACTION = "Changed status from Open to Closed"
BACKFILL_CLOSE_NOTE = "Appended Analyst Note: System auto-resolve. Confirmed normal customer transfers."
BACKFILL_REASONS = {
    "high": "Dataset Target Fraud Account (Row {row}, Label F3924 = 1). ML probability: {ml}.",
    "medium": "Dataset Medium Risk Account (Row {row}). Moderate risk characteristics. ML score: {ml}.",
    "low": "Low Risk Dataset Account (Row {row}). Verified low-risk behavioral characteristics. ML score: {ml}.",
}

# FIXED VALUES — analyst view labels and alert-type keywords
DEFAULT_HOLDER = "Robert P. Jenkins"
BENEFICIARY_PREFIX = "Beneficiary: "
PRIORITY_LABELS = {"Critical": "P1 - Immediate", "High": "P2 - Review"}
DEFAULT_PRIORITY = "P3 - Monitor"
MULE_KEYWORDS = ["mule", "target", "fraud"]
NETWORK_KEYWORDS = ["network", "ip", "proxy", "sanction", "ofac"]
