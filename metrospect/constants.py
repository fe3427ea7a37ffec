"""They must be exactly these for results to agree with the published pipeline."""

METRICS = ["cc", "mi", "comment_ratio", "h_volume", "h_difficulty", "h_effort", "sloc"]
GEOMETRY_METRICS = ["comment_ratio", "h_volume", "h_difficulty", "h_effort", "cc", "sloc", "mi"]
REPORT_METRICS = ["comment_ratio", "mi"]
POOLS = ["last", "mean"]

MIN_CHARS = 50
MAX_CHARS = 6500
MAX_TOKENS = 2048

# Hash split: bucket = first 8 hex digits mod 100; below 80 train, below 90 val, else test.
SPLIT_BUCKETS = 100
TRAIN_BELOW = 80
VAL_BELOW = 90

SCHEMA_VERSION = 1
SHARD_SIZE_MB = 100
NORM_FLOOR = 1e-8
RIDGE_ALPHA = 1.0

INVALID_STATUS_WORDS = ["syntax", "invalid", "empty"]
MISSING_CELL = "   —       —   "
