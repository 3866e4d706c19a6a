"""Fixed values of the data model. They decide results, so they are stated here as plain text."""

# Event types accepted by the event log.
RUN_STARTED = "extraction_run_started"
RUN_COMPLETED = "extraction_run_completed"
RUN_FAILED = "extraction_run_failed"
FILE_EXTRACTION = "file_extraction"
PROGRESS_UPDATE = "progress_update"
JOB_STATUS_UPDATE = "job_status_update"
EVENT_TYPES = [RUN_STARTED, RUN_COMPLETED, RUN_FAILED, FILE_EXTRACTION, PROGRESS_UPDATE, JOB_STATUS_UPDATE]

# A cancel request is no event of the log; it joins the run fold as one more type.
RUN_CANCELLED = "extraction_run_cancelled"

# Run phases, job states, file states, asset roles, edge types.
STARTED, COMPLETED, FAILED = "STARTED", "COMPLETED", "FAILED"
RUNNING = "RUNNING"
SUCCESS, SKIPPED = "SUCCESS", "SKIPPED"
SOURCE, TARGET, INTERMEDIATE = "SOURCE", "TARGET", "INTERMEDIATE"
TABLE_EDGE, COLUMN_EDGE = "table_edge", "column_edge"

# Defaults.
UNKNOWN_SCHEMA = "unknown_schema"
UNKNOWN_HASH = "unknown"
UNKNOWN_TRANSFORMATION = "UNKNOWN"
UNKNOWN_REPOSITORY = "unknown"
DEFAULT_BRANCH = "main"
PLACEHOLDER_TRIGGER = "docker_container"
REQUEST_TRIGGER = "api"
DEFAULT_RUN_MODE = "FULL"
EXTRACTOR_VERSION = "1.0.0"
LOG_SOURCE = "docker"
ENTITY_TYPE = "table"
COLUMN_TYPE = "varchar"
CANCEL_ERROR = "Run cancelled by user"
EXIT_LINE = r"^Docker container exited with code: (-?[0-9]+)$"
LAUNCH_ERROR_LINE = r"^Error launching Docker container: "
SECRET_MASK = "***"
SEARCH_LIMIT = 50
RUN_PAGE = 20
LOG_PAGE = 100
RECENT_DAYS = 7

UPSTREAM, DOWNSTREAM = "upstream", "downstream"

# Layout of the stored tables: rows are spread over this many directories by run.
RUN_BUCKETS = 64

# Layout of the copies by name.
NAME_BUCKETS = 64

# Order of arrival. `event_tie` is 0 unless the landed line carries no sequence number.
ARRIVAL = ["event_seq", "event_tie"]
EVENT_KEY = ["run_id", "event_seq", "event_tie"]
