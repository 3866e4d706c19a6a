"""Run state and job history folded from events, scan requests and cancel requests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import text as T

RUN_COLUMNS = [
    "run_id", "repository_url", "branch", "commit_hash", "run_mode", "phase", "triggered_by", "extractor_version",
    "started_at", "finished_at", "stats", "created_at", "updated_at",
]


def run_facts(decoded: DataFrame) -> DataFrame:
    """What the fold needs to know of each run: its first event, its last terminal event, its last stats, its last event.

    All are minima or maxima by arrival, so facts of several batches merge into the facts of the whole.
    """
    usable = F.col("reason").isNull()
    phase = F.when(F.col("event_type") == C.RUN_COMPLETED, C.COMPLETED).when(
        F.col("event_type") == C.RUN_FAILED, C.FAILED
    )
    first = F.struct(
        *C.ARRIVAL,
        (F.col("event_type") == C.RUN_STARTED).alias("by_start"),
        F.col("started.repositoryUrl").alias("repository_url"),
        F.col("started.branch").alias("branch"),
        F.col("started.triggeredBy").alias("triggered_by"),
        F.col("event_time").alias("at"),
    )
    terminal = F.struct(*C.ARRIVAL, phase.alias("phase"), F.col("event_time").alias("at"))
    return decoded.groupBy("run_id").agg(
        F.min(F.when(F.col("makes_run"), first)).alias("first"),
        F.max(F.when(usable & phase.isNotNull(), terminal)).alias("terminal"),
        F.max(F.when(F.col("stats").isNotNull(), K.arrival())).alias("stats_at"),
        F.max_by("stats", F.when(F.col("stats").isNotNull(), K.arrival())).alias("stats"),
        F.max(F.when(usable, K.arrival())).alias("last"),
    ).filter(F.col("first").isNotNull())


def merge_run_facts(parts: DataFrame) -> DataFrame:
    return parts.groupBy("run_id").agg(
        F.min("first").alias("first"),
        F.max("terminal").alias("terminal"),
        F.max("stats_at").alias("stats_at"),
        F.max_by("stats", "stats_at").alias("stats"),
        F.max("last").alias("last"),
    )


def _created(field: str, placeholder: str) -> Column:
    return F.when(F.col("first.by_start"), F.col(f"first.{field}")).otherwise(placeholder)


def runs_from_facts(facts: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Run rows. A start event seen first names the run; any other first event makes a placeholder, and a later
    start does not repair it. The last terminal event decides the phase. A registered run keeps its own fields.
    """
    folded = facts.select(
        "run_id",
        _created("repository_url", C.UNKNOWN_REPOSITORY).alias("repository_url"),
        _created("branch", C.DEFAULT_BRANCH).alias("branch"),
        F.lit(None).cast("string").alias("commit_hash"),
        F.lit(C.DEFAULT_RUN_MODE).alias("run_mode"),
        F.coalesce("terminal.phase", F.lit(C.STARTED)).alias("phase"),
        _created("triggered_by", C.PLACEHOLDER_TRIGGER).alias("triggered_by"),
        F.lit(C.EXTRACTOR_VERSION).alias("extractor_version"),
        F.col("first.at").alias("started_at"),
        F.col("terminal.at").alias("finished_at"),
        "stats",
        F.col("first.at").alias("created_at"),
        F.coalesce("terminal.at", "first.at").alias("updated_at"),
    )
    if registered is None:
        return folded
    from_events = {"phase", "finished_at", "stats", "updated_at"}
    e, r = folded.alias("e"), registered.select(*[c for c in RUN_COLUMNS if c in registered.columns]).alias("r")

    def pick(name: str) -> Column:
        if name not in registered.columns:
            return F.col(f"e.{name}").alias(name)
        order = ("e", "r") if name in from_events else ("r", "e")
        return F.coalesce(*[F.col(f"{side}.{name}") for side in order]).alias(name)

    return e.join(r, F.col("e.run_id") == F.col("r.run_id"), "full_outer").select(*[pick(c) for c in RUN_COLUMNS])


def register_runs(requests: DataFrame) -> DataFrame:
    """Scan requests (`run_id, repository_url, branch, commit_hash, run_mode, triggered_by, requested_at`) to
    run rows. Absent fields take their default; a field stated blank rejects the request."""
    filled = _with_request_defaults(requests)
    return filled.filter(F.col("reject_reason").isNull()).select(
        "run_id",
        "repository_url",
        "branch",
        "commit_hash",
        "run_mode",
        F.lit(C.STARTED).alias("phase"),
        "triggered_by",
        F.lit(C.EXTRACTOR_VERSION).alias("extractor_version"),
        F.col("requested_at").alias("started_at"),
        F.lit(None).cast("timestamp_ntz").alias("finished_at"),
        F.col("requested_at").alias("created_at"),
        F.col("requested_at").alias("updated_at"),
    )


def rejected_requests(requests: DataFrame) -> DataFrame:
    return _with_request_defaults(requests).filter(F.col("reject_reason").isNotNull()).select("run_id", "reject_reason")


def _with_request_defaults(requests: DataFrame) -> DataFrame:
    filled = requests.withColumns(
        {
            "branch": F.coalesce("branch", F.lit(C.DEFAULT_BRANCH)),
            "run_mode": F.coalesce("run_mode", F.lit(C.DEFAULT_RUN_MODE)),
            "triggered_by": F.coalesce("triggered_by", F.lit(C.REQUEST_TRIGGER)),
        }
    )
    reason = F.when(~F.col("run_mode").isin("FULL", "INCREMENTAL"), "bad_run_mode")
    for name in ("repository_url", "branch", "triggered_by"):
        reason = reason.when(T.is_white(F.col(name)), f"blank:{name}")
    return filled.withColumn("reject_reason", reason)


def judge_cancels(
    cancels: DataFrame, decoded: DataFrame, guarded: bool = False, registered: DataFrame | None = None
) -> DataFrame:
    """Each cancel request (`run_id, event_seq, event_tie, event_time`) with its `outcome`.

    A run must exist when the request arrives: by an event, or because it was registered, which comes before all
    events. The guarded form also refuses a run that has ended by then, be it by an event or by an earlier cancel.
    """
    phase_event = F.col("reason").isNull() & F.col("event_type").isin(C.RUN_COMPLETED, C.RUN_FAILED)
    known = decoded.groupBy("run_id").agg(
        F.min(F.when(F.col("makes_run"), K.arrival())).alias("born"),
        F.min(F.when(phase_event, K.arrival())).alias("ended"),
    )
    judged = cancels.join(known, "run_id", "left").withColumn("is_registered", F.lit(False))
    if registered is not None:
        named = registered.select("run_id", F.lit(True).alias("named")).distinct()
        judged = judged.join(named, "run_id", "left").withColumn("is_registered", F.coalesce("named", F.lit(False)))
    unborn = ~F.col("is_registered") & (F.col("born").isNull() | (K.arrival() < F.col("born")))
    judged = judged.withColumn("outcome", F.when(unborn, "unknown_run").otherwise("applied"))
    if guarded:
        first_cancel = (
            judged.filter("outcome = 'applied'").groupBy("run_id").agg(F.min(K.arrival()).alias("first_cancel"))
        )
        judged = judged.join(first_cancel, "run_id", "left").withColumn(
            "outcome",
            F.when(
                (F.col("outcome") == "applied")
                & ((F.col("ended") < K.arrival()) | (F.col("first_cancel") < K.arrival())),
                "already_ended",
            ).otherwise(F.col("outcome")),
        )
    return judged.select(*C.EVENT_KEY, "event_time", "outcome")


def cancel_facts(judged: DataFrame) -> DataFrame:
    """Applied cancels in the form of run facts: a terminal event of phase FAILED."""
    terminal = F.struct(*C.ARRIVAL, F.lit(C.FAILED).alias("phase"), F.col("event_time").alias("at"))
    return judged.filter("outcome = 'applied'").groupBy("run_id").agg(F.max(terminal).alias("terminal"))


def fold_runs(
    decoded: DataFrame, cancels: DataFrame | None = None, guarded: bool = False, registered: DataFrame | None = None
) -> DataFrame:
    """Events, and cancel requests as one more kind of event, to run rows."""
    facts = run_facts(decoded)
    if cancels is not None:
        extra = cancel_facts(judge_cancels(cancels, decoded, guarded, registered))
        facts = merge_run_facts(facts.unionByName(extra, allowMissingColumns=True))
    return runs_from_facts(facts, registered)


def _job(sub_seq: int, status: str, phase: Column, error: Column | None = None) -> Column:
    return F.struct(
        F.lit(sub_seq).alias("sub_seq"),
        F.lit(status).alias("status"),
        phase.alias("current_phase"),
        (F.lit(None).cast("string") if error is None else error).alias("last_error"),
    )


JOB_COLUMNS = [
    "job_id", "run_id", "event_seq", "event_tie", "sub_seq", "pod_id", "status", "total_files", "processed_files",
    "succeeded_files", "failed_files", "current_file", "processing_speed", "estimated_time_remaining",
    "current_phase", "error_count", "last_error", "last_updated", "created_at",
]


def job_history(
    decoded: DataFrame, cancels: DataFrame | None = None, guarded: bool = False, registered: DataFrame | None = None
) -> DataFrame:
    """One job row per event, two per completion, none for file events. Counters count only JSON numbers; the
    error counter is not read from job status updates."""
    kind = F.col("event_type")
    phase = F.col("progress.currentPhase")
    rows = (
        F.when(kind == C.RUN_STARTED, F.array(_job(0, C.RUNNING, F.lit("started"))))
        .when(
            kind == C.RUN_COMPLETED,
            F.array(
                _job(0, C.RUNNING, F.lit("processing_lineage")),
                _job(1, C.COMPLETED, F.lit("completed")),
            ),
        )
        .when(kind == C.RUN_FAILED, F.array(_job(0, C.FAILED, F.lit("failed"), F.col("error"))))
        .when(kind.isin(C.PROGRESS_UPDATE, C.JOB_STATUS_UPDATE), F.array(_job(0, C.RUNNING, phase)))
    )
    counted = F.when(kind == C.PROGRESS_UPDATE, F.col("progress.errorCount"))
    parts = decoded.filter(F.col("reason").isNull() & (kind != C.FILE_EXTRACTION)).select(
        *C.EVENT_KEY,
        "pod_id",
        F.coalesce("progress.totalFiles", F.lit(0)).alias("total_files"),
        F.coalesce("progress.processedFiles", F.lit(0)).alias("processed_files"),
        F.col("progress.currentFile").alias("current_file"),
        F.coalesce(counted, F.lit(0)).alias("error_count"),
        F.col("event_time").alias("last_updated"),
        F.inline(rows),
    )
    asked = _request_parts(decoded, cancels, guarded, registered)
    return _job_rows(parts if asked is None else parts.unionByName(asked, allowMissingColumns=True))


def request_jobs(
    decoded: DataFrame, cancels: DataFrame | None = None, guarded: bool = False, registered: DataFrame | None = None
) -> DataFrame | None:
    """The job rows that requests bring, without those of events: one per registration and applied cancel."""
    asked = _request_parts(decoded, cancels, guarded, registered)
    return None if asked is None else _job_rows(asked)


def _request_parts(
    decoded: DataFrame, cancels: DataFrame | None, guarded: bool, registered: DataFrame | None
) -> DataFrame | None:
    parts = []
    if cancels is not None:
        applied = judge_cancels(cancels, decoded, guarded, registered).filter("outcome = 'applied'")
        error = F.lit(C.CANCEL_ERROR) if guarded else F.lit(None).cast("string")
        parts.append(
            applied.select(
                *C.EVENT_KEY,
                F.col("event_time").alias("last_updated"),
                F.lit(0).alias("sub_seq"),
                F.lit(C.FAILED).alias("status"),
                F.lit("cancelled").alias("current_phase"),
                error.alias("last_error"),
            )
        )
    if registered is not None:
        parts.append(
            registered.select(
                "run_id",
                F.lit(-1).cast("bigint").alias("event_seq"),
                F.lit(0).cast("bigint").alias("event_tie"),
                F.col("created_at").alias("last_updated"),
                F.lit(0).alias("sub_seq"),
                F.lit(C.RUNNING).alias("status"),
                F.lit("initialized").alias("current_phase"),
                F.lit(None).cast("string").alias("last_error"),
            )
        )
    return reduce(DataFrame.unionByName, parts) if parts else None


def _job_rows(parts: DataFrame) -> DataFrame:
    """Job rows with their ids and defaults; columns that `parts` lacks are null or 0."""
    kinds = {"pod_id": "string", "current_file": "string", "total_files": "int", "processed_files": "int", "error_count": "int"}
    parts = parts.withColumns({n: F.lit(None).cast(k) for n, k in kinds.items() if n not in parts.columns})
    zero = F.lit(0)
    nothing = F.lit(None).cast("decimal(10,2)")
    return (
        parts.withColumns(
            {
                "job_id": K.stable_id(*C.EVENT_KEY, "sub_seq"),
                "total_files": F.coalesce("total_files", zero),
                "processed_files": F.coalesce("processed_files", zero),
                "succeeded_files": zero,
                "failed_files": zero,
                "error_count": F.coalesce("error_count", zero),
                "processing_speed": nothing,
                "estimated_time_remaining": nothing,
                "created_at": F.col("last_updated"),
            }
        )
        .select(*JOB_COLUMNS)
    )
