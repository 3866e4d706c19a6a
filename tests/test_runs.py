import json

from pyspark.sql import functions as F

from edgeloom.operators import ingest_runs as R
from edgeloom.operators import jobs as J
from tests.helpers import decoded, event, rows

STARTED, DONE, BROKE = "extraction_run_started", "extraction_run_completed", "extraction_run_failed"


def start(run, seq, repo="repo"):
    return event(STARTED, run, seq, {"repositoryUrl": repo, "branch": "dev", "triggeredBy": "me"})


def cancels(spark, *pairs):
    df = spark.createDataFrame([(r, s) for r, s in pairs], "run_id string, event_seq bigint")
    return df.withColumns(
        {"event_tie": F.lit(0).cast("bigint"), "event_time": F.lit("2024-02-01T00:00:00").cast("timestamp_ntz")}
    )


def log(spark):
    return decoded(
        spark,
        start("a", 1), event(DONE, "a", 2, {"stats": {"n": 1}}), event(BROKE, "a", 3, {"error": "late"}),
        event(DONE, "b", 1, {"stats": [1]}), start("b", 2),
        start("c", 1), event(BROKE, "c", 2, {"error": "e"}), event(DONE, "c", 3, {"stats": {"n": 2}}),
        event(DONE, "c", 4, {"stats": 7}),
        event("progress_update", "d", 1, {"totalFiles": "5", "processedFiles": 2.9, "errorCount": 1, "currentPhase": "p"}),
        event("job_status_update", "d", 2, {"totalFiles": 5, "errorCount": 4}),
        event("file_extraction", "e", 1, None),
    )


def test_fold(spark):
    got = R.fold_runs(log(spark)).withColumn("stats", F.to_json("stats"))
    assert rows(got, "run_id", "repository_url", "branch", "triggered_by", "phase", "stats") == [
        ("a", "repo", "dev", "me", "FAILED", '{"n":1}'),
        ("b", "unknown", "main", "docker_container", "COMPLETED", None),
        ("c", "repo", "dev", "me", "COMPLETED", '{"n":2}'),
        ("d", "unknown", "main", "docker_container", "STARTED", None),
        ("e", "unknown", "main", "docker_container", "STARTED", None),
    ]


def test_job_history(spark):
    got = R.job_history(log(spark))
    columns = ("run_id", "event_seq", "sub_seq", "status", "current_phase", "total_files", "processed_files", "error_count")
    assert rows(got.filter("run_id in ('a', 'd', 'e')"), *columns) == [
        ("a", 1, 0, "RUNNING", "started", 0, 0, 0),
        ("a", 2, 0, "RUNNING", "processing_lineage", 0, 0, 0),
        ("a", 2, 1, "COMPLETED", "completed", 0, 0, 0),
        ("a", 3, 0, "FAILED", "failed", 0, 0, 0),
        ("d", 1, 0, "RUNNING", "p", 0, 2, 1),
        ("d", 2, 0, "RUNNING", None, 5, 0, 0),
    ]
    assert rows(got.filter("last_error is not null"), "run_id", "last_error") == [("a", "late"), ("c", "e")]
    assert rows(J.newest_jobs(got).filter("run_id = 'c'"), "current_phase") == [("completed",)]


def test_cancel_is_one_more_terminal_event(spark):
    asked = cancels(spark, ("a", 9), ("d", 1000), ("b", 0), ("z", 1), ("d", 1001))
    d = log(spark)
    assert rows(R.fold_runs(d, asked), "run_id", "phase")[:4] == [
        ("a", "FAILED"), ("b", "COMPLETED"), ("c", "COMPLETED"), ("d", "FAILED"),
    ]
    assert rows(R.judge_cancels(asked, d), "run_id", "event_seq", "outcome") == [
        ("a", 9, "applied"), ("b", 0, "unknown_run"), ("d", 1000, "applied"), ("d", 1001, "applied"),
        ("z", 1, "unknown_run"),
    ]
    assert rows(R.judge_cancels(asked, d, guarded=True), "run_id", "event_seq", "outcome") == [
        ("a", 9, "already_ended"), ("b", 0, "unknown_run"), ("d", 1000, "applied"), ("d", 1001, "already_ended"),
        ("z", 1, "unknown_run"),
    ]
    job = R.job_history(d, asked, guarded=True).filter("current_phase = 'cancelled'")
    assert rows(job, "run_id", "event_seq", "status", "last_error") == [("d", 1000, "FAILED", "Run cancelled by user")]


def test_cancel_after_completion_overrides(spark):
    d = decoded(spark, start("a", 1), event(DONE, "a", 2, {}))
    assert rows(R.fold_runs(d, cancels(spark, ("a", 3))), "phase") == [("FAILED",)]
    assert rows(R.fold_runs(d, cancels(spark, ("a", 3)), guarded=True), "phase") == [("COMPLETED",)]


def test_registered_runs_keep_their_fields(spark):
    ddl = (
        "run_id string, repository_url string, branch string, commit_hash string, run_mode string, "
        "triggered_by string, requested_at timestamp_ntz"
    )
    asked = spark.createDataFrame(
        [("a", "mine", None, "c1", "INCREMENTAL", None, None), ("n", "mine", "dev", None, None, None, None),
         ("x", " ", None, None, None, None, None), ("y", "u", None, None, "ODD", None, None)],
        ddl,
    )
    known = R.register_runs(asked)
    assert rows(R.rejected_requests(asked), "run_id", "reject_reason") == [
        ("x", "blank:repository_url"), ("y", "bad_run_mode"),
    ]
    got = R.fold_runs(decoded(spark, start("a", 1), event(DONE, "a", 2, {})), registered=known)
    assert rows(got, "run_id", "repository_url", "branch", "commit_hash", "run_mode", "triggered_by", "phase") == [
        ("a", "mine", "main", "c1", "INCREMENTAL", "api", "COMPLETED"),
        ("n", "mine", "dev", None, "FULL", "api", "STARTED"),
    ]
    first = R.job_history(decoded(spark, start("a", 1)), registered=known).filter("current_phase = 'initialized'")
    assert rows(first, "run_id") == [("a",), ("n",)]


def test_job_default_for_runs_without_rows(spark):
    d = log(spark)
    got = J.job_status(R.fold_runs(d), R.job_history(d)).filter("run_id = 'e'")
    assert rows(got, "status", "current_phase", "total_files", "error_count") == [("FAILED", "unknown", 0, 0)]


def test_facts_of_batches_merge(spark):
    d = log(spark)
    parts = [R.run_facts(d.filter(F.col("event_seq") % 2 == i)) for i in (0, 1)]
    merged = R.runs_from_facts(R.merge_run_facts(parts[0].unionByName(parts[1])))
    whole = R.fold_runs(d)
    as_text = [c if c != "stats" else F.to_json("stats").alias("stats") for c in whole.columns]
    assert rows(merged.select(as_text), "*") == rows(whole.select(as_text), "*")
    assert json.loads(rows(whole.select(as_text).filter("run_id = 'c'"), "stats")[0][0]) == {"n": 2}


def test_cancel_of_a_registered_run_before_its_first_event(spark):
    """The usual cancel: asked for, registered, stopped before anything came. Only the unregistered run is unknown."""
    requests = spark.createDataFrame(
        [("new", "repo", None, None, None, None)],
        "run_id string, repository_url string, branch string, commit_hash string, run_mode string, triggered_by string",
    ).withColumn("requested_at", F.lit("2024-01-01T00:00:00").cast("timestamp_ntz"))
    registered = R.register_runs(requests)
    asked = cancels(spark, ("new", 5), ("nobody", 5))
    d = decoded(spark, start("other", 1))
    judged = R.judge_cancels(asked, d, registered=registered)
    assert rows(judged, "run_id", "outcome") == [("new", "applied"), ("nobody", "unknown_run")]
    runs = R.fold_runs(d, asked, registered=registered)
    assert rows(runs, "run_id", "phase") == [("new", "FAILED"), ("other", "STARTED")]
    jobs = R.job_history(d, asked, registered=registered).filter("run_id = 'new'")
    assert rows(jobs, "event_seq", "status", "current_phase") == [(-1, "RUNNING", "initialized"), (5, "FAILED", "cancelled")]
    only = R.request_jobs(d, asked, registered=registered)
    assert rows(only, *only.columns) == rows(jobs, *only.columns)
    assert R.request_jobs(d) is None
