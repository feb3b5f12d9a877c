"""Fixed values.

Each one must equal the value the checks were defined with; another value
gives other results. They are stated here once and imported everywhere else.
"""

# States that count as "in flight".
IN_FLIGHT_RUN_STATES = ("running", "queued")
IN_FLIGHT_TASK_STATES = ("running", "queued", "scheduled", "deferred")

# Words shown for a run or task.
UNQUEUED = "unqueued"
FAILED_LABEL = "FAILED"
BLOCKED_LABEL = "blocked"
NO_LOG_FILE = "(no log file for this task)"

# Lines of an import-error listing that carry no error.
NOISE_LINE_PATTERNS = (
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T",
    r"^No data found",
    r"^filepath",
)

# Limits of the reports.
VERDICT_TIMEOUT_S = 3600
LISTED_RUNS = 3
LISTED_IMPORT_ERRORS = 5
LOG_TAIL_LINES = 60
EXCERPT_CHARS = 80

# Files the scan leaves out: prose, and folders that name terms on purpose.
PROSE_SUFFIXES = (".md", ".txt")
UNSCANNED_ROOTS = ("product", "data", "tests")

# What puts the lines of a log that is read in splits in order.
LINE_ORDER = ("block_start", "place")

# Text after this mark is a comment and is not scanned.
COMMENT_MARK = "#"
