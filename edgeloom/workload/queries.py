"""The registered queries, each with the SQL that must give the same rows. Keys are the ids of the survey.

Parameters stand where the operator has them (a page, a cut-off time, search texts); everything else is answered
for all runs, assets, names and files of the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import payload as P
from edgeloom.functions import text as T
from edgeloom.operators import catalog as CA
from edgeloom.operators import entities as EN
from edgeloom.operators import files as FI
from edgeloom.operators import ingest_assets as IA
from edgeloom.operators import ingest_edges as IE
from edgeloom.operators import ingest_files as IF
from edgeloom.operators import ingest_runs as IR
from edgeloom.operators import jobs as JO
from edgeloom.operators import lineage as LI
from edgeloom.operators import logs as LO
from edgeloom.operators import name_search as NS
from edgeloom.operators import runs as RU
from edgeloom.plans import nested as NE
from edgeloom.sources import container_logs as CL
from edgeloom.sources import events as EV
from edgeloom.sources import tables as TB
from edgeloom.workload import fixtures as X
from edgeloom.workload.sql import over, sid

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return register


def _lit_time(text: str):
    return F.lit(text).cast("timestamp_ntz")


#: Names that are asked for, in the key they are compared by: one per part, a third of them unknown.
_ASKED = "SELECT concat('TBL_', CAST(p_partkey % 60 AS VARCHAR)) FROM part"


# --- sources and sinks ------------------------------------------------------------------------------------------


@query(
    over(
        "rk",
        """SELECT CASE WHEN event_seq % 23 = 0 THEN ' ' ELSE run_id END AS run_id, event_seq, pod_id, kind AS event_type,
  CASE WHEN event_seq % 19 <> 0 THEN ts END AS event_time, coalesce(reason, 'ok') AS reason
FROM rk WHERE kind <> 'cancel'""",
    )
)
def src_1(spark, sf):
    lines = EV.read_event_lines(spark, X.run_log(spark, sf))
    return EV.parse_envelope(lines).select(
        "run_id", "event_seq", "pod_id", "event_type", "event_time", F.coalesce("reason", F.lit("ok")).alias("reason")
    )


@query("""
SELECT concat('run-', CAST(user_id AS VARCHAR)) AS run_id,
  CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 3 <> 0) THEN 'ERROR' ELSE 'INFO' END AS log_level,
  CASE event_type WHEN 'purchase' THEN 'Docker container exited with code: 0'
    WHEN 'error' THEN concat('Docker container exited with code: ', CAST(event_id % 3 AS VARCHAR))
    WHEN 'signup' THEN concat('Error launching Docker container: ', props) ELSE props END AS message,
  ts AS log_time, 'docker' AS source
FROM events""")
def src_2(spark, sf):
    return CL.log_rows(X.output_lines(spark, sf)).select("run_id", "log_level", "message", "log_time", "source")


@query("""
SELECT concat('run-', CAST(user_id AS VARCHAR)) AS run_id,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, message) AS INTEGER) AS line_no, message,
  CASE WHEN event_type = 'signup' OR (event_type = 'error' AND event_id % 3 <> 0) THEN 'ERROR' ELSE 'INFO' END AS log_level
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'Docker container exited with code: 0'
    WHEN 'error' THEN concat('Docker container exited with code: ', CAST(event_id % 3 AS VARCHAR))
    WHEN 'signup' THEN concat('Error launching Docker container: ', props) ELSE props END AS message FROM events)""")
def src_2_files(spark, sf):
    """Log files read back, each line with its place: the lines of a run are in the order they were written, equal ones too."""
    rows = CL.read_log_files(spark, X.log_files(spark, sf), range_bytes=4096)
    order = Window.partitionBy("run_id").orderBy("file", "at")
    return rows.withColumn("line_no", F.row_number().over(order)).select("run_id", "line_no", "message", "log_level")


@query(over("e", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e"))
def src_3(spark, sf):
    return X.lake(spark, sf)["lineage"].select("lineage_id", "run_id", "from_short", "to_short", "edge_type")


@query(over("a", "SELECT asset_id, run_id, short_name FROM a ORDER BY short_name, created_at, asset_id LIMIT 20 OFFSET 40"))
def src_4(spark, sf):
    assets = X.lake(spark, sf)["assets"].select("asset_id", "run_id", "short_name", "created_at")
    return TB.scan_page(assets, [F.asc(c) for c in CA.ASSET_ORDER], 2, 20).drop("created_at")


@query(
    over(
        "a",
        """SELECT asset_id, run_id, short_name, (SELECT count(*) FROM a) AS total_elements FROM a
ORDER BY short_name, created_at, asset_id LIMIT 20 OFFSET (SELECT (count(*) // 20 - 1) * 20 FROM a)""",
    )
)
def src_4_deep(spark, sf):
    """The last full page, found by counts."""
    ranked = X.ranked_assets(spark, sf)
    page = ranked.page(ranked.total() // 20 - 1, 20)
    return page.select("asset_id", "run_id", "short_name", "total_elements")


@query(
    over(
        "m a col e links",
        """SELECT 'files' AS table_name, run_id, count(*) AS n_rows FROM (SELECT DISTINCT run_id, event_seq FROM m) GROUP BY ALL
UNION ALL SELECT 'assets', run_id, count(*) FROM a GROUP BY ALL
UNION ALL SELECT 'asset_columns', run_id, count(*) FROM col GROUP BY ALL
UNION ALL SELECT 'lineage', run_id, count(*) FROM e GROUP BY ALL
UNION ALL SELECT 'asset_files', run_id, count(*) FROM links GROUP BY ALL
UNION ALL SELECT 'extraction_runs', run_id, 1 FROM (SELECT DISTINCT run_id FROM m)""",
    )
)
def snk_1(spark, sf):
    lake = X.lake(spark, sf)
    names = ["files", "assets", "asset_columns", "lineage", "asset_files", "extraction_runs"]
    parts = [
        lake[n].groupBy("run_id").agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(n).alias("table_name"), "run_id", "n_rows"
        )
        for n in names
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows


@query(
    over(
        "tr nb",
        """SELECT tr.direction, tr.entity_id, nb.entity_name, tr.neighbor, nb.neighbor_full, tr.file_id,
  tr.transformation_type, tr.start_line, tr.end_line
FROM tr JOIN nb ON nb.direction = tr.direction AND nb.entity_id = tr.entity_id AND nb.neighbor = tr.neighbor""",
    )
)
def snk_2(spark, sf):
    """Nested JSON answers, opened again: all transformations are there once."""
    lake = X.lake(spark, sf)
    answers = NE.answers_as_json(NE.lineage_answers(lake["assets"], lake["lineage"]))
    step = "fileId STRING, transformation_type STRING, lines STRUCT<start_line INT, end_line INT>"
    node = f"entityId STRING, entityName STRING, transformations ARRAY<STRUCT<{step}>>"
    opened = answers.select(
        "direction",
        "entity_id",
        F.from_json("answer", f"entityName STRING, lineage STRUCT<{node}>").alias("j"),
    )
    nodes = opened.select("direction", "entity_id", F.col("j.entityName").alias("entity_name"), F.col("j.lineage").alias("n"))
    steps = nodes.select("direction", "entity_id", "entity_name", "n.entityId", "n.entityName", F.explode("n.transformations").alias("t"))
    return steps.select(
        "direction",
        "entity_id",
        "entity_name",
        F.col("entityId").alias("neighbor"),
        F.col("entityName").alias("neighbor_full"),
        F.col("t.fileId").alias("file_id"),
        "t.transformation_type",
        "t.lines.start_line",
        "t.lines.end_line",
    )


# --- event decoding and routing ---------------------------------------------------------------------------------


@query(over("m", "SELECT DISTINCT run_id, event_seq, event_time, 'file_extraction' AS event_type, file_path FROM m"))
def ing_1(spark, sf):
    envelopes = EV.parse_envelope(EV.read_event_lines(spark, X.file_log(spark, sf)))
    return envelopes.select(
        "run_id", "event_seq", "event_time", "event_type", P.text(F.col("data"), "$.filePath").alias("file_path")
    )


@query("""
SELECT event_id, CASE WHEN event_id % 11 = 0 OR event_id % 9 = 4 OR event_id % 8 = 1 THEN NULL
  ELSE CAST(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 1, 19 + CAST(event_id % 8 AS INTEGER)) AS TIMESTAMP) END AS event_time
FROM events""")
def ing_2(spark, sf):
    """Times with 0 to 6 fraction digits, a bare dot, a zone suffix, or a date only."""
    n = F.col("event_id")
    full = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    cut = F.substring(full, F.lit(1), (F.lit(19) + n % 8).cast("int"))
    stated = F.when(n % 11 == 0, F.substring(full, 1, 10)).when(n % 9 == 4, F.concat(cut, F.lit("Z"))).otherwise(cut)
    return X.table(spark, sf, "events").select("event_id", P.event_time(stated).alias("event_time"))


@query(over("r", "SELECT run_id, event_seq, kind AS event_type FROM r"))
def ing_3(spark, sf):
    decoded = X.run_decoded(spark, sf)
    branches = [EV.route(decoded, t).select("run_id", "event_seq", "event_type") for t in C.EVENT_TYPES]
    rows = branches[0]
    for b in branches[1:]:
        rows = rows.unionByName(b)
    return rows


@query(over("rk", "SELECT event_seq, 'event' AS item, reason FROM rk WHERE reason IS NOT NULL"))
def ing_4(spark, sf):
    return EV.quarantine(X.run_decoded(spark, sf)).select("event_seq", "item", "reason")


@query(
    over(
        "m",
        """SELECT DISTINCT run_id, event_seq, 'file_extraction' AS event_type, CAST(NULL AS VARCHAR) AS reason FROM m
UNION ALL SELECT DISTINCT run_id, event_seq, 'file_extraction', 'key_conflict' FROM m WHERE event_seq % 11 = 0""",
    )
)
def ing_4_conflicts(spark, sf):
    """A log with replays and with other texts under keys in use: each event once, each other text set aside once."""
    return X.repeated_decoded(spark, sf).select("run_id", "event_seq", "event_type", "reason")


@query(over("folded", "SELECT run_id, repository_url, branch, triggered_by FROM folded"))
def ing_5(spark, sf):
    return IR.fold_runs(X.run_decoded(spark, sf)).select("run_id", "repository_url", "branch", "triggered_by")


@query(
    over(
        "job_rows r",
        """SELECT j.run_id, j.event_seq, j.total_files, j.processed_files, j.error_count
FROM job_rows j JOIN r ON r.event_seq = j.event_seq WHERE r.kind IN ('progress_update', 'job_status_update')""",
    )
)
def ing_6(spark, sf):
    progress = X.run_decoded(spark, sf).filter(F.col("progress").isNotNull())
    return IR.job_history(progress).select("run_id", "event_seq", "total_files", "processed_files", "error_count")


# --- runs -------------------------------------------------------------------------------------------------------


@query(over("folded", "SELECT run_id, phase, started_at, finished_at FROM folded"))
def run_1(spark, sf):
    return IR.fold_runs(X.run_decoded(spark, sf)).select("run_id", "phase", "started_at", "finished_at")


@query(
    over(
        "r",
        """SELECT run_id, max_by(concat('{"files":', CAST(CAST(floor(value) AS INTEGER) AS VARCHAR), ',"k":',
  CAST(event_seq AS VARCHAR), '}'), event_seq) FILTER (WHERE kind = 'extraction_run_completed' AND event_seq % 2 = 0) AS stats
FROM r GROUP BY run_id""",
    )
)
def run_2(spark, sf):
    return IR.fold_runs(X.run_decoded(spark, sf)).select("run_id", F.to_json("stats").alias("stats"))


@query(
    over(
        "r cancels",
        """SELECT run_id, coalesce(max_by(phase, event_seq), 'STARTED') AS phase, max_by(ts, event_seq) AS finished_at
FROM (SELECT run_id, event_seq, ts, CASE kind WHEN 'extraction_run_completed' THEN 'COMPLETED' ELSE 'FAILED' END AS phase
      FROM r WHERE kind IN ('extraction_run_completed', 'extraction_run_failed')
      UNION ALL SELECT run_id, event_seq, ts, 'FAILED' FROM cancels WHERE outcome = 'applied'
      UNION ALL SELECT DISTINCT run_id, -1, CAST(NULL AS TIMESTAMP), 'STARTED' FROM r)
GROUP BY run_id""",
    )
)
def run_3(spark, sf):
    folded = IR.fold_runs(X.run_decoded(spark, sf), X.cancel_requests(spark, sf))
    return folded.select("run_id", "phase", "finished_at")


@query(over("guarded", "SELECT run_id, event_seq, outcome FROM guarded"))
def run_3_guarded(spark, sf):
    judged = IR.judge_cancels(X.cancel_requests(spark, sf), X.run_decoded(spark, sf), guarded=True)
    return judged.select("run_id", "event_seq", "outcome")


@query("""
SELECT concat('run-', CAST(o_orderkey AS VARCHAR)) AS run_id, concat('repo-', CAST(o_custkey % 50 AS VARCHAR)) AS repository_url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'main' ELSE lower(o_orderpriority) END AS branch,
  CASE WHEN o_orderkey % 5 = 0 THEN concat('commit-', CAST(o_orderkey AS VARCHAR)) END AS commit_hash,
  CASE o_orderkey % 3 WHEN 0 THEN 'INCREMENTAL' ELSE 'FULL' END AS run_mode, 'STARTED' AS phase,
  CASE WHEN o_orderkey % 7 = 0 THEN 'api' ELSE 'cron' END AS triggered_by, '1.0.0' AS extractor_version,
  o_orderdate AS started_at
FROM orders WHERE o_orderkey % 9 <> 0""")
def run_4(spark, sf):
    return IR.register_runs(X.scan_requests(spark, sf)).drop("finished_at", "created_at", "updated_at")


REGISTERED = """(SELECT concat('run-', CAST(o_orderkey AS VARCHAR)) AS run_id, concat('repo-', CAST(o_custkey % 50 AS VARCHAR)) AS repository_url,
  CASE WHEN o_orderkey % 4 = 0 THEN 'main' ELSE lower(o_orderpriority) END AS branch,
  CASE WHEN o_orderkey % 7 = 0 THEN 'api' ELSE 'cron' END AS triggered_by, o_orderdate AS started_at
FROM orders WHERE o_orderkey % 9 <> 0)"""


@query(
    over(
        "folded",
        f"""SELECT coalesce(g.run_id, f.run_id) AS run_id, coalesce(g.repository_url, f.repository_url) AS repository_url,
  coalesce(g.branch, f.branch) AS branch, coalesce(g.triggered_by, f.triggered_by) AS triggered_by, coalesce(f.phase, 'STARTED') AS phase,
  coalesce(g.started_at, f.started_at) AS started_at, f.finished_at
FROM folded f FULL OUTER JOIN {REGISTERED} g ON g.run_id = f.run_id""",
    )
)
def run_4_runs(spark, sf):
    """Registered runs together with those that events bring into being."""
    registered = IR.register_runs(X.scan_requests(spark, sf))
    folded = IR.fold_runs(X.run_decoded(spark, sf), registered=registered)
    return folded.select("run_id", "repository_url", "branch", "triggered_by", "phase", "started_at", "finished_at")


@query(
    over(
        "cancels",
        f"""SELECT run_id, CAST(-1 AS BIGINT) AS event_seq, 'RUNNING' AS status, 'initialized' AS current_phase, started_at AS last_updated
FROM {REGISTERED}
UNION ALL SELECT run_id, event_seq, 'FAILED', 'cancelled', ts FROM cancels
WHERE outcome = 'applied' OR run_id IN (SELECT run_id FROM {REGISTERED})""",
    )
)
def run_4_jobs(spark, sf):
    """The job rows of requests: one per registration, one per cancel of a run that is known by then."""
    registered = IR.register_runs(X.scan_requests(spark, sf))
    asked = IR.request_jobs(X.run_decoded(spark, sf), X.cancel_requests(spark, sf), registered=registered)
    return asked.select("run_id", "event_seq", "status", "current_phase", "last_updated")


@query(
    over(
        "r cancels",
        f"""SELECT run_id, coalesce(max_by(phase, event_seq), 'STARTED') AS phase, max_by(ts, event_seq) AS finished_at
FROM (SELECT run_id, event_seq, ts, CASE kind WHEN 'extraction_run_completed' THEN 'COMPLETED' ELSE 'FAILED' END AS phase
      FROM r WHERE kind IN ('extraction_run_completed', 'extraction_run_failed')
      UNION ALL SELECT run_id, event_seq, ts, 'FAILED' FROM cancels WHERE outcome = 'applied' OR run_id IN (SELECT run_id FROM {REGISTERED})
      UNION ALL SELECT run_id, -1, CAST(NULL AS TIMESTAMP), 'STARTED' FROM (SELECT run_id FROM r UNION SELECT run_id FROM {REGISTERED}))
GROUP BY run_id""",
    )
)
def run_3_registered(spark, sf):
    """Cancels of runs that events or requests made known."""
    registered = IR.register_runs(X.scan_requests(spark, sf))
    folded = IR.fold_runs(X.run_decoded(spark, sf), X.cancel_requests(spark, sf), registered=registered)
    return folded.select("run_id", "phase", "finished_at")


STATUS_SQL = """
SELECT r.*, j.current_phase, j.last_updated, coalesce(f.total_files, 0) AS total_files,
  coalesce(f.succeeded_files, 0) AS succeeded_files, coalesce(f.failed_files, 0) AS failed_files,
  coalesce(l.total_edges, 0) AS total_edges, coalesce(l.table_edges, 0) AS table_edges,
  coalesce(l.column_edges, 0) AS column_edges
FROM (SELECT run_id, repository_url, branch, phase, started_at, finished_at, triggered_by FROM runs) r
LEFT JOIN (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY last_updated DESC, job_id DESC) = 1) j
  ON j.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS total_files, count(*) FILTER (WHERE status = 'SUCCESS') AS succeeded_files,
    count(*) FILTER (WHERE status = 'FAILED') AS failed_files FROM files GROUP BY run_id) f ON f.run_id = r.run_id
LEFT JOIN (SELECT run_id, count(*) AS total_edges, count(*) FILTER (WHERE edge_type = 'table_edge') AS table_edges,
    count(*) FILTER (WHERE edge_type = 'column_edge') AS column_edges FROM e GROUP BY run_id) l ON l.run_id = r.run_id
"""


@query(over("runs jobs files e", STATUS_SQL))
def run_5(spark, sf):
    lineage = X.lake(spark, sf)["lineage"]
    return RU.run_status(X.runs(spark, sf), X.jobs(spark, sf), X.files(spark, sf), lineage)


PAGE_SQL = """
SELECT *, (SELECT count(*) FROM runs) AS total_elements, CAST(ceil((SELECT count(*) FROM runs) / 20.0) AS BIGINT) AS total_pages,
  1 AS current_page, 20 AS page_size
FROM runs ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 20"""


@query(over("runs", PAGE_SQL))
def run_6(spark, sf):
    return RU.run_page(X.runs(spark, sf), page_no=1, size=20)


@query(
    over(
        "runs",
        """SELECT run_id, repository_url AS source_repo, branch, phase AS status, triggered_by AS trigger, started_at, finished_at,
  created_at, 0 AS assets_delta, 0 AS edges_delta, 0 AS errors, (SELECT count(*) FROM runs) AS total_elements,
  CAST(ceil((SELECT count(*) FROM runs) / 20.0) AS BIGINT) AS total_pages, 2 AS current_page, 20 AS page_size
FROM runs ORDER BY created_at DESC, run_id LIMIT 20 OFFSET 40""",
    )
)
def run_6_list(spark, sf):
    """The list form of a page of runs."""
    return RU.run_summary_page(X.runs(spark, sf), page_no=2, size=20)


@query(
    over(
        "runs",
        """SELECT run_id, repository_url AS source_repo, branch, phase AS status, triggered_by AS trigger, started_at, finished_at,
  created_at, 0 AS assets_delta, 0 AS edges_delta, 0 AS errors
FROM runs WHERE created_at >= (SELECT max(created_at) FROM runs) - INTERVAL 7 DAY""",
    )
)
def run_7(spark, sf):
    """Recent as seen from the newest run."""
    runs = X.runs(spark, sf)
    return RU.recent_runs(runs, as_of=runs.select(F.max("created_at")).scalar())


@query(
    over(
        "runs jobs files e",
        STATUS_SQL + "WHERE r.run_id IN (SELECT concat('run-', CAST(s_suppkey AS VARCHAR)) FROM supplier)",
    )
)
def run_8(spark, sf):
    """Runs by id; asked ids without a run have no row."""
    ids = X.table(spark, sf, "supplier").select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run_id"))
    lineage = X.lake(spark, sf)["lineage"]
    return RU.run_status(X.runs(spark, sf), X.jobs(spark, sf), X.files(spark, sf), lineage, ids)


@query(over("runs", "SELECT * FROM runs"))
def run_9(spark, sf):
    return RU.runs_by_repository(X.runs(spark, sf))


@query(over("runs", "SELECT * FROM runs"))
def run_10(spark, sf):
    return RU.runs_by_phase(X.runs(spark, sf))


@query(over("runs", "SELECT * FROM runs WHERE repository_url = 'repo-7' AND branch = '1-urgent'"))
def run_11(spark, sf):
    return RU.runs_by_branch(X.runs(spark, sf), "repo-7", "1-urgent")


@query(over("runs", "SELECT phase, count(*) AS n_runs FROM runs GROUP BY phase"))
def run_12(spark, sf):
    return RU.count_by_phase(X.runs(spark, sf))


@query(over("runs", "SELECT * FROM runs WHERE triggered_by = 'MACHINERY'"))
def run_13(spark, sf):
    return RU.runs_by_trigger(X.runs(spark, sf), "MACHINERY")


# --- jobs -------------------------------------------------------------------------------------------------------


@query(over("job_rows", "SELECT * FROM job_rows"))
def job_1(spark, sf):
    return IR.job_history(X.run_decoded(spark, sf)).select(
        "job_id", "run_id", "event_seq", "sub_seq", "pod_id", "status", "total_files", "processed_files",
        "current_phase", "error_count", "last_error", "last_updated",
    )


NEWEST_JOB = "SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY last_updated DESC, job_id DESC) = 1"


@query(over("jobs", NEWEST_JOB))
def job_2(spark, sf):
    return JO.newest_jobs(X.jobs(spark, sf))


@query(
    over(
        "runs jobs",
        f"""SELECT runs.run_id, coalesce(j.status, 'FAILED') AS status, coalesce(j.current_phase, 'unknown') AS current_phase,
  coalesce(j.total_files, 0) AS total_files, coalesce(j.processed_files, 0) AS processed_files
FROM runs LEFT JOIN ({NEWEST_JOB}) j ON j.run_id = runs.run_id""",
    )
)
def job_3(spark, sf):
    return JO.job_status(X.runs(spark, sf), X.jobs(spark, sf)).select(
        "run_id", "status", "current_phase", "total_files", "processed_files"
    )


@query(over("jobs", "SELECT * FROM jobs"))
def job_4(spark, sf):
    return JO.job_log(X.jobs(spark, sf))


@query(over("jobs", "SELECT * FROM jobs WHERE status = 'FAILED'"))
def job_5(spark, sf):
    return JO.jobs_by_status(X.jobs(spark, sf), C.FAILED)


@query(
    over(
        "jobs",
        """SELECT * FROM jobs WHERE status = 'COMPLETED'
  AND run_id IN (SELECT concat('run-', CAST(s_suppkey AS VARCHAR)) FROM supplier)""",
    )
)
def job_6(spark, sf):
    ids = X.table(spark, sf, "supplier").select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run_id"))
    return JO.jobs_by_status(X.jobs(spark, sf), C.COMPLETED, ids)


@query(over("jobs", "SELECT * FROM jobs"))
def job_7(spark, sf):
    return JO.jobs_by_pod(X.jobs(spark, sf))


@query(over("jobs", "SELECT * FROM jobs WHERE status = 'RUNNING' AND last_updated < TIMESTAMP '2024-01-15 00:00:00'"))
def job_8(spark, sf):
    return JO.stale_jobs(X.jobs(spark, sf), C.RUNNING, _lit_time("2024-01-15T00:00:00"))


@query(over("jobs", "SELECT status, count(*) AS n_jobs FROM jobs GROUP BY status"))
def job_9(spark, sf):
    return JO.count_by_status(X.jobs(spark, sf))


# --- files ------------------------------------------------------------------------------------------------------


@query(
    over(
        "m",
        f"""SELECT DISTINCT {sid("run_id", "event_seq", "0")} AS file_id, run_id, file_path,
  CASE WHEN event_seq % 2 = 0 THEN 'JINJA2' ELSE 'SQL' END AS file_type,
  CASE WHEN event_seq % 3 = 0 THEN 'unknown' ELSE concat('h', CAST(event_seq AS VARCHAR)) END AS file_hash,
  CASE event_seq % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'SKIPPED' END AS status, event_time AS created_at
FROM m""",
    )
)
def fil_1(spark, sf):
    return IF.file_records(X.lake(spark, sf)["decoded"]).select(
        "file_id", "run_id", "file_path", "file_type", "file_hash", "status", "created_at"
    )


@query(over("files", "SELECT * FROM files"))
def fil_2(spark, sf):
    return FI.files_of_run(X.files(spark, sf))


@query(over("files", "SELECT *, n_copies FROM (SELECT *, count(*) OVER (PARTITION BY file_hash) AS n_copies FROM files) WHERE n_copies > 1"
            .replace("SELECT *, n_copies FROM", "SELECT * FROM")))
def fil_3(spark, sf):
    return FI.files_sharing_hash(X.files(spark, sf))


@query(over("files", "SELECT * FROM files QUALIFY count(*) OVER (PARTITION BY run_id, file_path) = 1"))
def fil_4(spark, sf):
    return FI.file_by_path(X.files(spark, sf))


@query(over("files", "SELECT * FROM files WHERE status = 'FAILED'"))
def fil_5(spark, sf):
    return FI.files_by_status(X.files(spark, sf), C.FAILED)


@query(over("files", "SELECT run_id, count(*) AS n_files FROM files GROUP BY run_id"))
def fil_6(spark, sf):
    return FI.count_by_run(X.files(spark, sf))


@query(
    over(
        "files",
        """SELECT run_id, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success,
  count(*) FILTER (WHERE status = 'FAILED') AS n_failed, count(*) FILTER (WHERE status = 'SKIPPED') AS n_skipped
FROM files GROUP BY run_id""",
    )
)
def fil_7(spark, sf):
    return FI.count_by_run_and_status(X.files(spark, sf))


@query(over("files", "SELECT * FROM files WHERE file_type = 'JINJA2'"))
def fil_8(spark, sf):
    return FI.files_by_type(X.files(spark, sf), "JINJA2")


# --- logs -------------------------------------------------------------------------------------------------------


@query(over("logs", "SELECT * FROM logs"))
def log_1(spark, sf):
    return LO.logs_oldest_first(X.logs(spark, sf))


RANKED = """SELECT *, CAST(row_number() OVER (PARTITION BY run_id ORDER BY log_time DESC, log_id DESC) AS INTEGER) AS rn,
  count(*) OVER (PARTITION BY run_id) AS total FROM logs"""


@query(over("logs", f"SELECT * FROM ({RANKED}) WHERE rn > 10 AND rn <= 20"))
def log_2(spark, sf):
    return LO.log_page(X.logs(spark, sf), page_no=1, size=10)


@query(over("logs", f"SELECT * EXCLUDE (rn, total), total AS total_elements FROM ({RANKED}) WHERE run_id = 'run-7' AND rn > 4 AND rn <= 8"))
def log_2_seek(spark, sf):
    """A page of one run's lines, found by counts."""
    return X.ranked_logs(spark, sf).page(1, 4, run_id="run-7")


@query(over("logs", f"SELECT * EXCLUDE (total) FROM ({RANKED}) WHERE rn <= 5"))
def log_3(spark, sf):
    return LO.recent_logs(X.logs(spark, sf), 5)


@query(over("logs", "SELECT * FROM logs WHERE log_time > TIMESTAMP '2024-01-20 12:00:00'"))
def log_4(spark, sf):
    return LO.logs_since(X.logs(spark, sf), _lit_time("2024-01-20T12:00:00"))


@query(over("logs", "SELECT run_id, count(*) AS total FROM logs GROUP BY run_id"))
def log_5(spark, sf):
    return LO.count_logs(X.logs(spark, sf))


@query(over("logs", "SELECT * FROM logs WHERE log_time >= TIMESTAMP '2024-01-10 00:00:00'"))
def log_6(spark, sf):
    return LO.logs_after_retention(X.logs(spark, sf), _lit_time("2024-01-10T00:00:00"))


@query(over("logs", "SELECT * REPLACE (CAST(log_id AS VARCHAR) AS log_id) FROM logs WHERE log_time >= TIMESTAMP '2024-01-10 09:30:00'"))
def log_6_stored(spark, sf):
    """Retention on a stored table: whole days are dropped, one day is written again."""
    return X.kept_logs(spark, sf).drop("log_date")


@query(
    over(
        "logs",
        f"""SELECT * EXCLUDE (rn), 0 AS page, 100 AS size FROM ({RANKED})
WHERE log_time > TIMESTAMP '2024-01-25 00:00:00'""",
    )
)
def log_7(spark, sf):
    return LO.log_answer(X.logs(spark, sf), since=_lit_time("2024-01-25T00:00:00"))


@query(over("logs", f"SELECT * EXCLUDE (rn), 1 AS page, 10 AS size FROM ({RANKED}) WHERE rn > 10 AND rn <= 20"))
def log_7_page(spark, sf):
    """The page form of the log view."""
    return LO.log_answer(X.logs(spark, sf), page_no=1, size=10)


# --- assets and columns -----------------------------------------------------------------------------------------


@query(over("m", "SELECT run_id, event_seq, pos, name FROM m"))
def ast_1(spark, sf):
    return IA.unnest_tables(X.lake(spark, sf)["decoded"]).select("run_id", "event_seq", "pos", "name")


@query(over("m", "SELECT run_id, event_seq, pos, role FROM m"))
def ast_2(spark, sf):
    mentions = IA.unnest_tables(X.lake(spark, sf)["decoded"])
    return IA.with_role(mentions).select("run_id", "event_seq", "pos", "role")


@query(over("m", "SELECT run_id, event_seq, pos, schema_name FROM m"))
def ast_3(spark, sf):
    mentions = IA.unnest_tables(X.lake(spark, sf)["decoded"])
    return IA.with_schema(mentions).select("run_id", "event_seq", "pos", "schema_name")


@query(over("m", "SELECT run_id, event_seq, pos, concat(schema_name, '.', name) AS full_name FROM m"))
def ast_4(spark, sf):
    mentions = IA.with_schema(IA.unnest_tables(X.lake(spark, sf)["decoded"]))
    return IA.with_full_name(mentions).select("run_id", "event_seq", "pos", "full_name")


@query(over("m", "SELECT run_id, event_seq, pos, name, role FROM m WHERE role <> 'INTERMEDIATE'"))
def ast_5(spark, sf):
    mentions = IA.with_role(IA.unnest_tables(X.lake(spark, sf)["decoded"]))
    return IA.without_intermediates(mentions).select("run_id", "event_seq", "pos", "name", "role")


@query(over("a", "SELECT * FROM a"))
def ast_6(spark, sf):
    assets = IA.first_assets(IA.asset_mentions(X.lake(spark, sf)["decoded"]))
    return assets.drop("first_tie", "first_pos")


@query(over("links", "SELECT * FROM links"))
def ast_7(spark, sf):
    lake = X.lake(spark, sf)
    return IA.asset_links(IA.asset_mentions(lake["decoded"]), lake["lineage"])


@query(over("a", "SELECT asset_id, run_id, short_name, role FROM a"))
def ast_8(spark, sf):
    return CA.assets_of_run(X.lake(spark, sf)["assets"]).select("asset_id", "run_id", "short_name", "role")


@query(
    over(
        "a",
        """SELECT asset_id, run_id, full_name FROM a
QUALIFY row_number() OVER (PARTITION BY run_id, full_name ORDER BY created_at, asset_id) = 1""",
    )
)
def ast_9(spark, sf):
    return CA.asset_by_full_name(X.lake(spark, sf)["assets"]).select("asset_id", "run_id", "full_name")


@query(over("a m", "SELECT asset_id, run_id, short_name, full_name FROM a WHERE (run_id, short_name) IN (SELECT run_id, to_short FROM m)"))
def ast_10(spark, sf):
    keys = X.mentions(spark, sf).select("run_id", F.col("to_table").alias("short_name"))
    found = CA.asset_by_short_name(X.lake(spark, sf)["assets"], keys)
    return found.select("asset_id", "run_id", "short_name", "full_name")


@query(over("a", "SELECT upper(short_name) AS name_key, asset_id, run_id, short_name FROM a"))
def ast_11(spark, sf):
    return CA.assets_by_name(X.lake(spark, sf)["assets"]).select("name_key", "asset_id", "run_id", "short_name")


@query(over("c", "SELECT name_key, asset_id, short_name, full_name, created_at FROM c"))
def ast_12(spark, sf):
    newest = CA.newest_by_name(X.lake(spark, sf)["assets"])
    return newest.select("name_key", "asset_id", "short_name", "full_name", "created_at")


@query(
    over(
        "a deg links",
        """SELECT t.*, coalesce(deg.upstream_count, 0) AS upstream_count, coalesce(deg.downstream_count, 0) AS downstream_count,
  (SELECT min(created_at) FROM links WHERE links.asset_id = t.asset_id) AS first_seen_at,
  (SELECT max(created_at) FROM links WHERE links.asset_id = t.asset_id) AS last_seen_at,
  (SELECT count(*) FROM a WHERE contains(lower(short_name), 'bl_1') OR contains(lower(full_name), 'bl_1')) AS total_elements,
  CAST(ceil((SELECT count(*) FROM a WHERE contains(lower(short_name), 'bl_1') OR contains(lower(full_name), 'bl_1')) / 20.0) AS BIGINT)
    AS total_pages, 1 AS current_page, 20 AS page_size
FROM (SELECT asset_id, short_name, full_name, schema_name, role, created_at FROM a
      WHERE contains(lower(short_name), 'bl_1') OR contains(lower(full_name), 'bl_1')
      ORDER BY short_name, created_at, asset_id LIMIT 20 OFFSET 20) t
LEFT JOIN deg ON deg.asset_id = t.asset_id""",
    )
)
def ast_13(spark, sf):
    lake = X.lake(spark, sf)
    return CA.list_assets(lake["assets"], lake["lineage"], lake["asset_files"], q="BL_1", page_no=1, size=20)


@query(
    over(
        "a deg",
        """SELECT a.asset_id, a.short_name, coalesce(deg.upstream_count, 0) AS upstream_count,
  coalesce(deg.downstream_count, 0) AS downstream_count FROM a LEFT JOIN deg ON deg.asset_id = a.asset_id""",
    )
)
def ast_14(spark, sf):
    lake = X.lake(spark, sf)
    counted = CA.with_degrees(lake["assets"], lake["lineage"])
    return counted.select("asset_id", "short_name", "upstream_count", "downstream_count")


@query(over("links", "SELECT asset_id, min(created_at) AS first_seen_at, max(created_at) AS last_seen_at FROM links GROUP BY asset_id"))
def ast_15(spark, sf):
    return CA.seen(X.lake(spark, sf)["asset_files"])


@query(over("links a", "SELECT asset_file_id, run_id, file_id, asset_id FROM links WHERE asset_id IN (SELECT asset_id FROM a WHERE role = 'TARGET')"))
def ast_16(spark, sf):
    lake = X.lake(spark, sf)
    targets = lake["assets"].filter(F.col("role") == C.TARGET).select("asset_id")
    found = CA.links_of(lake["asset_files"], assets=targets)
    return found.select("asset_file_id", "run_id", "file_id", "asset_id")


@query(
    over(
        "a ent",
        """SELECT a.asset_id, ent.entity_id AS short_name, ent.entity_name AS full_name, a.schema_name, a.role, ent.column_count,
  ent.upstream_count, ent.downstream_count, ent.upstream_count > 0 AS has_upstream, ent.downstream_count > 0 AS has_downstream
FROM a JOIN ent ON ent.name_key = upper(a.short_name)""",
    )
)
def ast_17(spark, sf):
    lake = X.lake(spark, sf)
    return EN.asset_details(lake["assets"], lake["lineage"], lake["asset_columns"])


@query(
    over(
        "a c col",
        """SELECT a.asset_id, col.column_name, 'varchar' AS column_type
FROM a JOIN c ON c.name_key = upper(a.short_name) JOIN col ON col.asset_id = c.asset_id AND col.role = 'TARGET'""",
        lower=True,
    )
)
def ast_17_columns(spark, sf):
    """The column list of every asset's detail."""
    lake = X.lower_lake(spark, sf)
    return EN.detail_columns(lake["assets"], lake["asset_columns"])


@query(over("c", f"SELECT name_key, asset_id, short_name, full_name, created_at FROM c WHERE name_key IN ({_ASKED})"))
def ast_12_asked(spark, sf):
    """The newest asset of asked names, from the copy by name."""
    newest = CA.newest_by_name(X.by_name(spark, sf)["assets"], X.asked_names(spark, sf).select("asked_id"))
    return newest.select("name_key", "asset_id", "short_name", "full_name", "created_at")


@query(over("cm", "SELECT run_id, event_seq, pos, column_pos, column_name FROM cm"))
def col_1(spark, sf):
    named = IA.column_mentions(IA.asset_mentions(X.lake(spark, sf)["decoded"]))
    return named.select("run_id", "event_seq", "pos", "column_pos", "column_name")


@query(over("col", "SELECT * FROM col"))
def col_2(spark, sf):
    return IA.first_columns(IA.column_mentions(IA.asset_mentions(X.lake(spark, sf)["decoded"])))


@query(over("col c", "SELECT asset_column_id, asset_id, column_name, role FROM col WHERE asset_id IN (SELECT asset_id FROM c)"))
def col_3(spark, sf):
    lake = X.lake(spark, sf)
    newest = CA.newest_by_name(lake["assets"]).select("asset_id")
    return CA.asset_columns(lake["asset_columns"], newest).select("asset_column_id", "asset_id", "column_name", "role")


@query(over("col", "SELECT asset_column_id, asset_id, column_name, role FROM col WHERE role = 'TARGET'"))
def col_4(spark, sf):
    found = CA.asset_columns(X.lake(spark, sf)["asset_columns"], role=C.TARGET)
    return found.select("asset_column_id", "asset_id", "column_name", "role")


COLUMNS_LEFT = """SELECT asset_column_id, asset_id, column_name FROM col
WHERE asset_id NOT IN (SELECT asset_id FROM a WHERE schema_name = 'unknown_schema')"""


@query(over("col a", COLUMNS_LEFT))
def col_5(spark, sf):
    lake = X.lake(spark, sf)
    gone = lake["assets"].filter(F.col("schema_name") == C.UNKNOWN_SCHEMA)
    return CA.columns_without(lake["asset_columns"], gone).select("asset_column_id", "asset_id", "column_name")


@query(over("col a", COLUMNS_LEFT))
def col_5_stored(spark, sf):
    """The same on a stored table, whose touched buckets alone are written again."""
    return X.kept_columns(spark, sf).select("asset_column_id", "asset_id", "column_name")


# --- edges ------------------------------------------------------------------------------------------------------


@query(
    over(
        "m",
        """SELECT run_id, event_seq, edge_pos AS pos, concat('db.', from_short) AS from_table, to_short AS to_table,
  CASE WHEN array_no = 0 AND edge_type = 'column_edge' THEN 'COLUMN_LINEAGE' WHEN array_no = 0 THEN NULL
    WHEN array_no IN (1, 3) THEN 'TABLE_EDGE' ELSE 'COLUMN_EDGE' END AS edge_type
FROM m""",
    )
)
def edg_1(spark, sf):
    return IE.unnest_edges(X.lake(spark, sf)["decoded"]).select(
        "run_id", "event_seq", "pos", "from_table", "to_table", "edge_type"
    )


@query(over("m", "SELECT run_id, event_seq, edge_pos AS pos, from_short, to_short FROM m"))
def edg_2(spark, sf):
    edges = IE.with_both_ends(IE.unnest_edges(X.lake(spark, sf)["decoded"]))
    return edges.select(
        "run_id",
        "event_seq",
        "pos",
        T.short_name(F.col("from_table")).alias("from_short"),
        T.short_name(F.col("to_table")).alias("to_short"),
    )


@query(over("m", "SELECT run_id, event_seq, edge_pos AS pos, edge_type FROM m"))
def edg_3(spark, sf):
    edges = IE.unnest_edges(X.lake(spark, sf)["decoded"])
    return IE.with_edge_type(edges).select("run_id", "event_seq", "pos", "edge_type")


@query(over("m", "SELECT run_id, event_seq, edge_pos AS pos, coalesce(stated_transformation, 'UNKNOWN') AS transformation_type FROM m"))
def edg_4(spark, sf):
    edges = IE.unnest_edges(X.lake(spark, sf)["decoded"])
    return IE.with_transformation(edges).select("run_id", "event_seq", "pos", "transformation_type")


@query(over("m", "SELECT run_id, event_seq, edge_pos AS pos, start_line, end_line FROM m"))
def edg_5(spark, sf):
    edges = IE.unnest_edges(X.lake(spark, sf)["decoded"])
    return edges.select("run_id", "event_seq", "pos", "start_line", "end_line")


@query(over("e", "SELECT lineage_id, run_id, from_short, from_full, to_short, to_full FROM e"))
def edg_6(spark, sf):
    lake = X.lake(spark, sf)
    resolved = IE.resolve_edges(IE.edge_mentions(lake["decoded"]), lake["assets"], how="inner")
    return resolved.select("lineage_id", "run_id", "from_short", "from_full", "to_short", "to_full")


@query(over("x", "SELECT run_id, event_seq, pos, file_path, from_short, to_short, skip_reason FROM x WHERE skip_reason IS NOT NULL"))
def edg_7(spark, sf):
    lake = X.lake(spark, sf)
    resolved = IE.resolve_edges(IE.edge_mentions(lake["decoded"]), lake["assets"])
    return IE.skipped_edges(resolved).drop("event_tie")


@query(over("e", "SELECT * FROM e"))
def edg_8(spark, sf):
    return X.lake(spark, sf)["lineage"].drop("event_tie", "run_bucket")


EDGE_VIEW = ["lineage_id", "run_id", "from_short", "to_short", "edge_type"]


@query(over("e", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE run_id IN (SELECT concat('run-', CAST(s_suppkey AS VARCHAR)) FROM supplier)"))
def edg_9(spark, sf):
    ids = X.table(spark, sf, "supplier").select(F.concat(F.lit("run-"), F.col("s_suppkey").cast("string")).alias("run_id"))
    return LI.edges_of_run(X.lake(spark, sf)["lineage"], ids).select(*EDGE_VIEW)


@query(over("e c", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE to_asset_id IN (SELECT asset_id FROM c)"))
def edg_10(spark, sf):
    lake = X.lake(spark, sf)
    return LI.edges_into(lake["lineage"], CA.newest_by_name(lake["assets"]).select("asset_id")).select(*EDGE_VIEW)


@query(over("e c", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE from_asset_id IN (SELECT asset_id FROM c)"))
def edg_11(spark, sf):
    lake = X.lake(spark, sf)
    return LI.edges_out_of(lake["lineage"], CA.newest_by_name(lake["assets"]).select("asset_id")).select(*EDGE_VIEW)


@query(over("e", "SELECT upper(to_short) AS name_key, lineage_id, run_id, from_short, to_short, edge_type FROM e"))
def edg_12(spark, sf):
    return LI.edges_into_name(X.lake(spark, sf)["lineage"]).select("name_key", *EDGE_VIEW)


@query(over("e", "SELECT upper(from_short) AS name_key, lineage_id, run_id, from_short, to_short, edge_type FROM e"))
def edg_13(spark, sf):
    return LI.edges_out_of_name(X.lake(spark, sf)["lineage"]).select("name_key", *EDGE_VIEW)


@query(
    over(
        "e",
        """SELECT lineage_id AS edge_id, concat('{"edgeId":"', lineage_id, '","edgeType":"', edge_type, '","fromEntity":"', from_short,
  '","toEntity":"', to_short, '","fromColumn":"', from_column, '","toColumn":"', to_column, '","fileId":"', file_path,
  '","lines":{"start_line":', CAST(start_line AS VARCHAR), ',"end_line":', CAST(end_line AS VARCHAR),
  '},"transformationType":"', transformation_type, '"}') AS answer
FROM e""",
    )
)
def edg_14(spark, sf):
    return NE.edge_details_as_json(LI.edge_details(X.lake(spark, sf)["lineage"]))


@query(over("e", f"SELECT upper(to_short) AS name_key, lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE upper(to_short) IN ({_ASKED})"))
def edg_12_asked(spark, sf):
    """Edges into asked names, from the copy by name."""
    asked = X.asked_names(spark, sf).select("asked_id")
    return LI.edges_into_name(X.by_name(spark, sf)[C.UPSTREAM], asked).select("name_key", *EDGE_VIEW)


@query(over("e", f"SELECT upper(from_short) AS name_key, lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE upper(from_short) IN ({_ASKED})"))
def edg_13_asked(spark, sf):
    """Edges out of asked names, from the copy by name."""
    asked = X.asked_names(spark, sf).select("asked_id")
    return LI.edges_out_of_name(X.by_name(spark, sf)[C.DOWNSTREAM], asked).select("name_key", *EDGE_VIEW)


@query(over("e c", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE to_asset_id IN (SELECT asset_id FROM c)", lower=True))
def edg_10_lower(spark, sf):
    lake = X.lower_lake(spark, sf)
    return LI.edges_into(lake["lineage"], CA.newest_by_name(lake["assets"]).select("asset_id")).select(*EDGE_VIEW)


@query(over("e c", "SELECT lineage_id, run_id, from_short, to_short, edge_type FROM e WHERE from_asset_id IN (SELECT asset_id FROM c)", lower=True))
def edg_11_lower(spark, sf):
    lake = X.lower_lake(spark, sf)
    return LI.edges_out_of(lake["lineage"], CA.newest_by_name(lake["assets"]).select("asset_id")).select(*EDGE_VIEW)


# --- search and entities ----------------------------------------------------------------------------------------

SEARCHES = [" TBL_1 ", "sch_2", "_", "%", "", "unknown_schema.tbl_3", "9"]


@query(
    over(
        "a",
        """SELECT q AS query, short_name AS entity_id, full_name AS entity_name, 'table' AS entity_type, rn
FROM (SELECT v.q, a.short_name, a.full_name, CAST(row_number() OVER (PARTITION BY v.q ORDER BY a.short_name, a.created_at, a.asset_id)
        AS INTEGER) AS rn
      FROM a, (VALUES (' TBL_1 '), ('sch_2'), ('_'), ('%'), (''), ('unknown_schema.tbl_3'), ('9')) AS v(q)
      WHERE trim(v.q) <> '' AND (contains(lower(a.short_name), lower(trim(v.q))) OR contains(lower(a.full_name), lower(trim(v.q)))))
WHERE rn <= 50""",
    )
)
def sch_1(spark, sf):
    return CA.search(X.lake(spark, sf)["assets"], SEARCHES).drop("column_count")


@query(
    over(
        "a",
        """SELECT q AS query, short_name AS entity_id, full_name AS entity_name, 'table' AS entity_type, rn
FROM (SELECT v.q, a.short_name, a.full_name, CAST(row_number() OVER (PARTITION BY v.q ORDER BY a.short_name, a.created_at, a.asset_id)
        AS INTEGER) AS rn
      FROM a, (SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN concat(' BL_', CAST(p_partkey % 60 AS VARCHAR))
        WHEN 1 THEN concat('sch_', CAST(p_partkey % 9 AS VARCHAR)) ELSE p_name END AS q FROM part) AS v
      WHERE contains(lower(a.short_name), lower(trim(v.q))) OR contains(lower(a.full_name), lower(trim(v.q))))
WHERE rn <= 50""",
    )
)
def sch_1_indexed(spark, sf):
    """Search texts from a table, over the index of pieces."""
    return NS.search_names(X.lake(spark, sf)["assets"], X.name_index(spark, sf), X.search_texts(spark, sf))


@query(over("ent", "SELECT * EXCLUDE (asset_id), upstream_count > 0 AS has_upstream, downstream_count > 0 AS has_downstream FROM ent"))
def ent_1(spark, sf):
    lake = X.lake(spark, sf)
    return EN.entities(lake["assets"], lake["lineage"], lake["asset_columns"])


@query(over("c col", "SELECT c.short_name AS entity_id, col.asset_column_id, col.column_name, 'varchar' AS column_type FROM c JOIN col ON col.asset_id = c.asset_id WHERE col.role = 'TARGET'"))
def ent_1_columns(spark, sf):
    lake = X.lake(spark, sf)
    return EN.target_columns(lake["assets"], lake["asset_columns"])


@query(over("pairs", "SELECT * FROM pairs"))
def ent_2(spark, sf):
    lake = X.lake(spark, sf)
    return EN.entity_pairs(lake["assets"], lake["lineage"]).drop("at")


@query(
    over(
        "ent",
        """SELECT p.p_partkey AS position, concat('Tbl_', CAST(p.p_partkey % 60 AS VARCHAR)) AS asked_id, ent.* EXCLUDE (name_key, asset_id),
  ent.upstream_count > 0 AS has_upstream, ent.downstream_count > 0 AS has_downstream
FROM part p JOIN ent ON ent.name_key = concat('TBL_', CAST(p.p_partkey % 60 AS VARCHAR))""",
    )
)
def ent_3(spark, sf):
    """One asked id per part; a third of them name nothing."""
    lake = X.lake(spark, sf)
    asked = X.table(spark, sf, "part").select(
        F.col("p_partkey").alias("position"),
        F.concat(F.lit("Tbl_"), (F.col("p_partkey") % 60).cast("string")).alias("asked_id"),
    )
    return EN.bulk_entities(lake["assets"], lake["lineage"], lake["asset_columns"], asked)


@query(over("pairs", "SELECT * FROM pairs", lower=True))
def ent_2_lower(spark, sf):
    lake = X.lower_lake(spark, sf)
    return EN.entity_pairs(lake["assets"], lake["lineage"]).drop("at")


@query(over("ent", "SELECT * EXCLUDE (asset_id), upstream_count > 0 AS has_upstream, downstream_count > 0 AS has_downstream FROM ent", lower=True))
def ent_1_lower(spark, sf):
    lake = X.lower_lake(spark, sf)
    return EN.entities(lake["assets"], lake["lineage"], lake["asset_columns"])


@query(
    over(
        "c col",
        """SELECT p.p_partkey AS position, c.short_name AS entity_id, col.asset_column_id, col.column_name, 'varchar' AS column_type
FROM part p JOIN c ON c.name_key = concat('TBL_', CAST(p.p_partkey % 60 AS VARCHAR))
JOIN col ON col.asset_id = c.asset_id AND col.role = 'TARGET'""",
        lower=True,
    )
)
def ent_3_columns(spark, sf):
    lake = X.lower_lake(spark, sf)
    return EN.bulk_columns(lake["assets"], lake["asset_columns"], X.asked_names(spark, sf))


@query(
    over(
        "pairs",
        """SELECT p.p_partkey AS position, pairs.*
FROM part p JOIN pairs ON upper(pairs.entity_id) = concat('TBL_', CAST(p.p_partkey % 60 AS VARCHAR))""",
        lower=True,
    )
)
def ent_3_pairs(spark, sf):
    lake = X.lower_lake(spark, sf)
    return EN.bulk_pairs(lake["assets"], lake["lineage"], X.asked_names(spark, sf))


# --- lineage ----------------------------------------------------------------------------------------------------


@query(over("c", "SELECT name_key, short_name AS entity_id, full_name AS entity_name FROM c"))
def lin_1(spark, sf):
    return LI.centres(X.lake(spark, sf)["assets"])


@query(over("nb", "SELECT * FROM nb"))
def lin_2(spark, sf):
    lake = X.lake(spark, sf)
    return LI.neighbours(lake["assets"], lake["lineage"])


@query(over("tr", "SELECT * FROM tr"))
def lin_3(spark, sf):
    lake = X.lake(spark, sf)
    return LI.transformations(lake["assets"], lake["lineage"])


@query(over("cp", "SELECT * FROM cp"))
def lin_4(spark, sf):
    lake = X.lake(spark, sf)
    return LI.column_lineage(lake["assets"], lake["lineage"])


@query(over("cp", "SELECT * FROM cp"))
def lin_5(spark, sf):
    """The nested answers of all entities: the members of their column pairs."""
    lake = X.lake(spark, sf)
    answers = NE.lineage_answers(lake["assets"], lake["lineage"]).filter(F.col("item") == NE.PAIR)
    up, down = F.col("fineGrainedLineages.upstreams")[0], F.col("fineGrainedLineages.downstreams")[0]
    step = up["transformation"]
    return answers.select(
        "direction",
        F.col("entityId").alias("entity_id"),
        up["urn"].alias("from_entity"),
        up["path"].alias("from_column"),
        down["urn"].alias("to_entity"),
        down["path"].alias("to_column"),
        step["fileId"].alias("file_id"),
        step["transformation_type"].alias("transformation_type"),
        step["lines"]["start_line"].alias("start_line"),
        step["lines"]["end_line"].alias("end_line"),
    )


@query(
    over(
        "c",
        """SELECT d.direction, c.short_name AS entity_id, c.full_name AS entity_name
FROM c, (VALUES ('upstream'), ('downstream')) AS d(direction)""",
    )
)
def lin_5_entities(spark, sf):
    """Every entity has an answer in both directions, also one without edges."""
    lake = X.lake(spark, sf)
    answers = NE.lineage_answers(lake["assets"], lake["lineage"]).filter(F.col("item") == NE.ENTITY)
    return answers.select("direction", F.col("entityId").alias("entity_id"), F.col("entityName").alias("entity_name"))


@query(over("a nb", "SELECT a.asset_id, nb.* FROM a JOIN nb ON upper(nb.entity_id) = upper(a.short_name)"))
def lin_6(spark, sf):
    lake = X.lake(spark, sf)
    return LI.lineage_of_assets(lake["assets"], lake["lineage"])


@query(over("nb", f"SELECT * FROM nb WHERE upper(entity_id) IN ({_ASKED})"))
def lin_2_asked(spark, sf):
    """Neighbours of asked names, from the copies by name."""
    copies = X.by_name(spark, sf)
    return LI.neighbours(copies["assets"], copies["lineage"], names=X.asked_names(spark, sf).select("asked_id"))


@query(over("a c", "SELECT a.asset_id, c.short_name AS entity_id, c.full_name AS entity_name FROM a JOIN c ON c.name_key = upper(a.short_name)"))
def lin_6_ids(spark, sf):
    """The entity that each asset id stands for."""
    return LI.entities_of_assets(X.lake(spark, sf)["assets"])


@query(
    over(
        "a c nb tr cp",
        """SELECT a.asset_id, d.direction, c.short_name AS entity_id,
  (SELECT count(*) FROM nb WHERE nb.direction = d.direction AND nb.entity_id = c.short_name) AS n_neighbours,
  (SELECT count(*) FROM tr WHERE tr.direction = d.direction AND tr.entity_id = c.short_name) AS n_transformations,
  (SELECT count(*) FROM cp WHERE cp.direction = d.direction AND cp.entity_id = c.short_name) AS n_pairs
FROM a JOIN c ON c.name_key = upper(a.short_name), (VALUES ('upstream'), ('downstream')) AS d(direction)""",
    )
)
def lin_6_answer(spark, sf):
    """The whole answer of every asset id: how many neighbours, transformations and column pairs it shares."""
    lake = X.lake(spark, sf)
    parts = LI.answers_of_assets(lake["assets"], lake["lineage"])
    both = F.explode(F.array(F.lit(C.UPSTREAM), F.lit(C.DOWNSTREAM))).alias("direction")
    rows = parts["ids"].select("asset_id", both, "entity_id")
    for name in ("neighbours", "transformations", "pairs"):
        counted = parts[name].groupBy("direction", "entity_id").agg(F.count(F.lit(1)).alias(f"n_{name}"))
        rows = rows.join(counted, ["direction", "entity_id"], "left")
    zero = F.lit(0).cast("bigint")
    return rows.withColumns({f"n_{n}": F.coalesce(f"n_{n}", zero) for n in ("neighbours", "transformations", "pairs")})


# --- streaming --------------------------------------------------------------------------------------------------


@query(over("e", "SELECT lineage_id, run_id, from_short, from_full, to_short, to_full, edge_type, start_line, created_at FROM e"))
def str_1(spark, sf):
    return X.streamed_files(spark, sf)["lineage"].select(
        "lineage_id", "run_id", "from_short", "from_full", "to_short", "to_full", "edge_type", "start_line", "created_at"
    )


@query(over("folded", "SELECT run_id, repository_url, branch, triggered_by, phase, started_at, finished_at FROM folded"))
def str_2(spark, sf):
    return X.streamed_runs(spark, sf)["extraction_runs"].select(
        "run_id", "repository_url", "branch", "triggered_by", "phase", "started_at", "finished_at"
    )


@query(over("m", "SELECT DISTINCT run_id, event_seq, 'event' AS item, 'key_conflict' AS reason FROM m WHERE event_seq % 11 = 0"))
def str_1_conflicts(spark, sf):
    """Other texts under keys that an earlier or the same landing has used."""
    return X.streamed_files(spark, sf)["quarantine"].select("run_id", "event_seq", "item", "reason")


@query(over("links", "SELECT * FROM links"))
def str_1_links(spark, sf):
    return X.streamed_files(spark, sf)["asset_files"].drop("run_bucket", "batch_id")


@query(over("a", "SELECT * FROM a"))
def str_2_assets(spark, sf):
    return X.streamed_files(spark, sf)["assets"].drop("first_tie", "first_pos", "run_bucket", "batch_id")


@query(over("col", "SELECT * FROM col"))
def str_2_columns(spark, sf):
    return X.streamed_files(spark, sf)["asset_columns"].drop("run_bucket", "batch_id")


@query(over("logs", "SELECT log_id, run_id, log_level, message, log_time FROM logs WHERE log_time > TIMESTAMP '2024-01-20 00:00:00'"))
def str_3(spark, sf):
    return X.streamed_logs(spark, sf).select("log_id", "run_id", "log_level", "message", "log_time")


@query(
    over(
        "x a",
        """SELECT x.lineage_id, x.run_id, x.from_short, f.full_name AS from_full, x.to_short, t.full_name AS to_full
FROM x JOIN a f ON f.run_id = x.run_id AND f.short_name = x.from_short
JOIN a t ON t.run_id = x.run_id AND t.short_name = x.to_short WHERE x.skip_reason IS NOT NULL""",
    )
)
def str_4(spark, sf):
    """Edges that arrived before their tables, as the optional repair finds them."""
    lake = X.lake(spark, sf)
    return IE.repair_edges(lake["edges"], lake["assets"]).select(
        "lineage_id", "run_id", "from_short", "from_full", "to_short", "to_full"
    )


# --- scalar functions over whole tables -------------------------------------------------------------------------


@query("""
SELECT doc_id, doc_id % 7 = 0 OR doc_id % 5 = 0 OR trim(text, concat(' ', chr(9), chr(10), chr(13))) = '' AS blank FROM documents""")
def fn_1(spark, sf):
    """Whole texts, with null and padding alone in the place of some."""
    text = F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 5 == 0, " \t\r\n").otherwise(F.col("text"))
    return X.table(spark, sf, "documents").select("doc_id", T.is_blank(text).alias("blank"))


@query("SELECT page_id, array_reverse(string_split(rtrim(url, '.'), '.'))[1] AS last_part FROM pages")
def fn_2(spark, sf):
    """Whole urls, with none to two dots at their ends."""
    url = F.concat("url", F.repeat(F.lit("."), (F.col("page_id") % 3).cast("int")))
    return X.table(spark, sf, "pages").select("page_id", T.short_name(url).alias("last_part"))


@query(f"""
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '{C.UNKNOWN_SCHEMA}' ELSE regexp_extract(url, '^(.*)\\.[^.]*$', 1) END AS schema_name
FROM pages""")
def fn_3(spark, sf):
    """Whole urls: some without a dot, some with dots at their ends."""
    n = F.col("page_id") % 4
    url = F.when(n == 0, F.translate("url", ".", "-")).when(n == 1, F.concat("url", F.lit(".."))).otherwise(F.col("url"))
    return X.table(spark, sf, "pages").select("page_id", T.schema_of_name(url).alias("schema_name"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE l_linenumber % 4 WHEN 0 THEN CAST(l_partkey AS INTEGER)
  WHEN 1 THEN CAST(l_partkey AS INTEGER) WHEN 2 THEN CAST(floor(l_extendedprice) AS INTEGER) END AS line
FROM lineitem""")
def fn_4(spark, sf):
    """Line references as `L12`, as text, as a fractional number, and as text that is none."""
    n, part = F.col("l_linenumber"), F.col("l_partkey").cast("string")
    stated = (
        F.when(n % 4 == 0, F.concat(F.lit('"L'), part, F.lit('"')))
        .when(n % 4 == 1, F.concat(F.lit('" '), part, F.lit('"')))
        .when(n % 4 == 2, F.col("l_extendedprice").cast("string"))
        .otherwise(F.concat(F.lit('"L '), part, F.lit('"')))
    )
    v = F.parse_json(stated)
    line = P.line_to_int(P.text(v), P.get(v, "$", "string"))
    return X.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", line.alias("line"))


@query("SELECT conv_id, turn, lower(trim(text, concat(' ', chr(9), chr(10), chr(13)))) AS text FROM conversations")
def fn_5(spark, sf):
    padded = F.concat(F.lit("\t "), "text", F.lit(" \r\n"))
    return X.table(spark, sf, "conversations").select("conv_id", "turn", T.trim_lower(padded).alias("text"))


@query("SELECT doc_id, contains(lower(text), 'th_') AS has_mark, contains(lower(text), 'the') AS has_word FROM documents")
def fn_6(spark, sf):
    text = F.col("text")
    return X.table(spark, sf, "documents").select(
        "doc_id",
        T.contains_any_case(text, F.lit("Th_")).alias("has_mark"),
        T.contains_any_case(text, F.lit("The")).alias("has_word"),
    )


@query("""
SELECT DISTINCT l_suppkey, l_linenumber, CASE WHEN l_linestatus = 'F' THEN '' ELSE l_returnflag END AS kind FROM lineitem""")
def fn_7(spark, sf):
    """Distinct keys in which a missing part and an empty part are the same."""
    kind = F.when(F.col("l_linestatus") == "F", F.when(F.col("l_linenumber") % 2 == 0, "")).otherwise(F.col("l_returnflag"))
    return (
        X.table(spark, sf, "lineitem")
        .select("l_suppkey", "l_linenumber", T.dedupe_part(kind).alias("kind"))
        .distinct()
    )


@query("""
SELECT c_custkey, concat(substr(c_name, 1, 3), '***', right(c_name, 3)) AS masked_name,
  CASE WHEN length(c_mktsegment) < 6 THEN '***' ELSE concat(left(c_mktsegment, 3), '***', right(c_mktsegment, 3)) END AS masked_segment
FROM customer""")
def fn_8(spark, sf):
    return X.table(spark, sf, "customer").select(
        "c_custkey",
        T.mask_secret(F.col("c_name")).alias("masked_name"),
        T.mask_secret(F.col("c_mktsegment")).alias("masked_segment"),
    )


@query("""
SELECT o_orderkey, CASE WHEN length(o_orderpriority) < 6 THEN '***'
  ELSE concat(left(o_orderpriority, 3), '***', right(o_orderpriority, 3)) END AS masked
FROM orders""")
def fn_8_short(spark, sf):
    """Priorities are short and long."""
    return X.table(spark, sf, "orders").select("o_orderkey", T.mask_secret(F.col("o_orderpriority")).alias("masked"))


@query("""
SELECT l_orderkey, n, least(40, n) AS first_row, least(least(40, n) + 20, n) AS stop_row, CAST(ceil(n / 20.0) AS BIGINT) AS pages
FROM (SELECT l_orderkey, sum(l_linenumber)::BIGINT AS n FROM lineitem GROUP BY l_orderkey)""")
def fn_9(spark, sf):
    sizes = X.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_linenumber").alias("n"))
    start, stop, pages = K.page_bounds(2, 20, F.col("n"))
    return sizes.select("l_orderkey", "n", start.alias("first_row"), stop.alias("stop_row"), pages.alias("pages"))


@query("""
SELECT doc_id, CASE WHEN lang = 'en' THEN 'JINJA2' ELSE 'SQL' END AS file_type,
  CASE doc_id % 4 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  CASE doc_id % 3 WHEN 0 THEN 'SOURCE' WHEN 1 THEN 'TARGET' ELSE 'INTERMEDIATE' END AS role,
  CASE doc_id % 3 WHEN 0 THEN 'column_edge' WHEN 1 THEN 'column_edge' ELSE 'table_edge' END AS edge_type
FROM documents""")
def fn_10(spark, sf):
    n = F.col("doc_id")
    return X.table(spark, sf, "documents").select(
        "doc_id",
        T.file_type(F.when(F.col("lang") == "en", "JINJA2").otherwise("jinja2")).alias("file_type"),
        T.file_status(F.when(n % 4 == 0, "success").when(n % 4 == 1, "failed").when(n % 4 == 2, "SUCCESS")).alias("status"),
        T.asset_role(F.when(n % 3 == 0, "Source").when(n % 3 == 1, "tArget").otherwise("cte")).alias("role"),
        T.edge_type(F.when(n % 3 == 0, "column_edge").when(n % 3 == 1, "Column_Lineage")).alias("edge_type"),
    )
