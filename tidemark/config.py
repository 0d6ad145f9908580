"""Fixed values that decide results. They state rules, so they are kept together."""

# Change classification, in percentage points of a share.
SAME_SHARE = 0.06
SMALL_MOVE = 1.0

# Verdict on R = (restatement + methodology) / changed.
GO_AT = 0.25
NOGO_BELOW = 0.10
REAL_CHURN = 0.052

# Portfolios and tests.
QUANTILE_LEGS = 5
RETURN_LOW = -0.9
RETURN_HIGH = 2.0
EXTREME_MOVE = 0.5
NW_LAGS_SPREAD = 6
NW_LAGS_DAILY = 5
NW_LAGS_MONTHLY_FACTOR = 3
ANNUAL_PCT_DAILY = 25150
ANNUAL_PCT_MONTHLY = 1200
ROBUST_CORR = 0.95
FRAGILE_CORR = 0.90
T_CONVENTIONAL = 1.96
T_NEW_FACTOR = 3.0
POWER_80 = 0.84

# Rank stability and degeneracy of a share.
DEGENERATE_MEDIAN = 0.95
DEGENERATE_IQR = 0.10
FOOTNOTE_SPEARMAN = 0.95
MIN_FIRMS = 10

# Crosswalk.
NAME_SIMILARITY = 0.7
MIN_BARS = 30
VALUE_FACTOR = 3
HOME_FACTOR = 3
CANDIDATE_CAPS = (20, 100, 500)

# Coverage windows.
DELIST_TOLERANCE = 10
COVERED_MONTHS = 0.90
COVERED_MEMBERS = 90.0
ROLLING_YEARS = 3
ROLLING_ROWS = 24
SIZE_TOLERANCE = 10
FAST_LAG_DAYS = 120

# Spellings of a missing value.
BLANK_WORDS = ("not found", "not applicable", "none", "nan")

# Party names that stand for an unnamed remainder.
RESIDUAL_WORDS = ("small shareholder", "natural person", "other shareholder", "unknown", "various")

# Statuses that count as operating.
OPERATING = ("operating", "operating pre-retirement")

# Factor-file codes for a missing number.
MISSING_CODES = (-99.99, -999.0)
