"""Constants that are part of the query semantics.

Fixed values: these must equal the values used by the system whose
behaviour this library reproduces, so results match it. They are listed
here in their natural order and are not derived from anything.
"""

# Fixed values -------------------------------------------------------------
# The ten topics, in polling order (the order is used as a tie-break).
TOPICS = [
    "politics", "business", "technology", "sports", "health",
    "climate", "science", "education", "entertainment", "finance",
]

CLASSIFY_BATCH = 32          # classifier batch size
CLASSIFY_PREFIX_CHARS = 512  # characters of body fed to the classifier
RAW_LOG_CAP = 5000           # raw article log keeps the newest 5000 (exact)
TOPIC_LOG_CAP = 10000        # per-topic log cap
FEED_CAP = 100               # per-user feed cap
SEEN_TTL_SECONDS = 24 * 3600  # life of one user's seen set
POP_RATE = 0.05              # reader pops per user per second
MAX_READER_RPS = 200.0       # reader rate cap
TOPIC_BACKLOG = 50           # default backlog of a topic read
DEFAULT_TOPIC = "unknown"    # producer label when an article has no topic
NO_TITLE = "[no-title]"      # title shown when a message has none

# Latency histogram bucket bounds in seconds (+Inf is implicit).
LATENCY_BOUNDS = [
    0.00005, 0.0001, 0.00025, 0.0005,
    0.001, 0.0025, 0.005, 0.01,
    0.025, 0.05, 0.1, 0.25, 0.5, 1.0,
]

# Relative-age thresholds in seconds: seconds below 90, minutes below
# 5400, hours below 172800, otherwise a "dd Mon" date.
AGE_SECONDS_LIMIT = 90
AGE_MINUTES_LIMIT = 5400
AGE_HOURS_LIMIT = 172800
# ---------------------------------------------------------------------------

# Epoch of the derived test views (all fixture times are offsets from it).
FIXTURE_EPOCH = "2024-01-01 00:00:00"
FIXTURE_EPOCH_US = 1704067200 * 1_000_000

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND
MICROS_PER_HOUR = 60 * MICROS_PER_MINUTE
MICROS_PER_DAY = 24 * MICROS_PER_HOUR
