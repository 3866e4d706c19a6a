"""The streamed ingest gives the tables of the batch ingest, also when lines are replayed."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from edgeloom.plans.ingest import ingest
from edgeloom.sources import container_logs as CL
from edgeloom.sources import placed_lines as PL
from edgeloom.sources.events import read_event_lines
from edgeloom.sources.tables import write_logs
from edgeloom.streaming.ingest import read_stream_lake, start_ingest
from edgeloom.streaming.log_tail import start_tail
from tests.helpers import edge, event, file_event, plan, rows, table

FIRST = [
    event("extraction_run_started", "r", 1, {"repositoryUrl": "u", "branch": "b", "triggeredBy": "t"}),
    file_event("r", 2, tables=[table("a", columns=["x"]), table("t", "target", columns=["y", "Y"])],
               lineageEdges=[edge("a", "t"), edge("a", "later")]),
    file_event("q", 3, tables=[table("a")]),
    "broken",
]
SECOND = [
    FIRST[1],
    file_event("r", 4, tables=[table("a", "target", schema="z", columns=["x", "n"]), table("later", columns=["y"])],
               lineageEdges=[edge("db.a", "later"), edge("a", "never")]),
    event("extraction_run_completed", "r", 5, {"stats": {"files": 2}}),
    event("extraction_run_failed", "q", 6, {"error": 5}),
]
THIRD = [SECOND[1], event("extraction_run_failed", "r", 7, {"error": "e"}), file_event("q", 8, lineageEdges=[edge("a", "a")])]



def stream(spark, tmp_path, *landings):
    """One micro-batch per landing."""
    (tmp_path / "landing").mkdir()
    for i, texts in enumerate(landings):
        (tmp_path / "landing" / f"{i}.json").write_text("\n".join(texts) + "\n")
        start_ingest(spark, str(tmp_path / "landing"), str(tmp_path / "stream"), str(tmp_path / "cp")).awaitTermination()
    return read_stream_lake(spark, str(tmp_path / "stream"))


COMPARED = {
    "files": ["file_id", "run_id", "status"],
    "assets": ["asset_id", "run_id", "short_name", "schema_name", "role", "first_seq"],
    "asset_columns": ["asset_column_id", "column_name", "role"],
    "edges": ["lineage_id", "from_full", "to_full", "skip_reason"],
    "lineage": ["lineage_id"],
    "asset_files": ["asset_file_id", "asset_id"],
    "job_status": ["job_id", "status", "current_phase", "last_error"],
    "extraction_runs": ["run_id", "repository_url", "phase", "finished_at"],
    "quarantine": ["run_id", "event_seq", "reason"],
}


def test_stream_equals_batch(spark, tmp_path):
    streamed = stream(spark, tmp_path, FIRST, SECOND, THIRD)
    batch = ingest(read_event_lines(spark, str(tmp_path / "landing")), str(tmp_path / "batch"))
    for name, columns in COMPARED.items():
        assert rows(streamed[name], *columns) == rows(batch[name], *columns), name
    assert rows(batch["extraction_runs"], "run_id", "phase") == [("q", "STARTED"), ("r", "FAILED")]
    assert rows(batch["lineage"], "event_seq", "from_short", "to_short") == [(2, "a", "t"), (4, "a", "later"), (8, "a", "a")]
    assert streamed["decoded"].select("batch_id").distinct().count() == 3


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    from edgeloom.streaming.ingest import apply_batch, prepare, unseen

    out = str(tmp_path / "out")
    prepare(spark, out)
    for batch_id, texts in ((0, FIRST), (1, SECOND[1:]), (1, SECOND[1:])):
        apply_batch(unseen(spark.createDataFrame([(t,) for t in texts], "value string")), batch_id, out)
    tables = read_stream_lake(spark, out)
    assert tables["files"].count() == 3
    assert tables["lineage"].count() == 2
    assert rows(tables["extraction_runs"], "run_id", "phase") == [("q", "STARTED"), ("r", "COMPLETED")]


def test_container_logs_and_tail(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "run-1.log").write_text("hello\nDocker container exited with code: 3\n")
    (logs / "run-2.log").write_text("Docker container exited with code: 0\nError launching Docker container: x\n")
    got = CL.read_container_logs(spark, str(logs))
    want = [
        ("run-1", "Docker container exited with code: 3", "ERROR"), ("run-1", "hello", "INFO"),
        ("run-2", "Docker container exited with code: 0", "INFO"),
        ("run-2", "Error launching Docker container: x", "ERROR"),
    ]
    assert rows(got, "run_id", "message", "log_level") == want
    write_logs(got, str(tmp_path / "stored"))
    assert rows(spark.read.parquet(str(tmp_path / "stored")), "run_id", "message", "log_level") == want

    stream = CL.stream_container_logs(spark, str(logs))
    start_tail(stream, str(tmp_path / "tail"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "tail")).count() == 4
    future = F.lit(dt.datetime(2100, 1, 1)).cast("timestamp_ntz")
    start_tail(CL.stream_container_logs(spark, str(logs)), str(tmp_path / "none"), str(tmp_path / "cp2"), future).awaitTermination()
    assert spark.read.schema(got.schema).parquet(str(tmp_path / "none")).count() == 0


def test_a_corrected_event_is_new_and_a_repeated_bad_line_is_not(spark, tmp_path):
    bad, good = file_event("r", 1).replace("2024-01-01T10:00:00", "no time"), file_event("r", 1)
    tables = stream(spark, tmp_path, [bad], [good, bad], [good])
    assert tables["files"].count() == 1
    assert rows(tables["quarantine"], "reason") == [("bad_timestamp",)]


def shuffled_log(seed):
    """Events of two runs whose tables are mentioned early, late, again and never, in an order of its own."""
    rng = random.Random(seed)
    names = ["a", "b", "c", "d", "e"]
    log = []
    for seq in range(1, 25):
        tables = [table(rng.choice(names), rng.choice(["source", "target", "other"]), schema=f"s{seq}", columns=rng.sample(["x", "y", "X"], 2)) for _ in range(rng.randint(0, 2))]
        edges = [edge(rng.choice(names), rng.choice(names)) for _ in range(rng.randint(0, 3))]
        log.append(file_event(rng.choice("qr"), seq, tables=tables, lineageEdges=edges))
    rng.shuffle(log)
    return log


def test_any_order_of_landing_gives_the_batch_tables(spark, tmp_path):
    log = shuffled_log(1)
    streamed = stream(spark, tmp_path, log[:6], log[6:14], [*log[14:], *log[:3]])
    batch = ingest(read_event_lines(spark, str(tmp_path / "landing")), str(tmp_path / "batch"))
    for name, columns in COMPARED.items():
        assert rows(streamed[name], *columns) == rows(batch[name], *columns), name
    assert spark.read.parquet(str(tmp_path / "stream" / "edge_fixes")).count() > 0


def test_a_conflict_over_two_batches_is_set_aside_once(spark, tmp_path):
    first, other, third = (file_event("r", 1, fileHash=h) for h in "abc")
    tables = stream(spark, tmp_path, [first, file_event("r", 2)], [other, first], [other, third, third])
    assert tables["files"].count() == 2
    assert rows(tables["quarantine"], "reason", "line") == [("key_conflict", other), ("key_conflict", third)]
    assert rows(tables["files"].filter("event_seq = 1"), "file_hash") == [("a",)]


def test_half_a_batch_is_invisible(spark, tmp_path, monkeypatch):
    from edgeloom.streaming import ingest as ING

    out = str(tmp_path / "out")
    ING.prepare(spark, out)

    def one(batch_id, texts):
        ING.apply_batch(ING.unseen(spark.createDataFrame([(t,) for t in texts], "value string")), batch_id, out)

    one(0, FIRST)
    before = {name: rows(read_stream_lake(spark, out)[name], *columns) for name, columns in COMPARED.items()}

    def lost(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ING.A, "asset_links", lost)
        with pytest.raises(RuntimeError):
            one(1, SECOND[1:])
    assert {name: rows(read_stream_lake(spark, out)[name], *columns) for name, columns in COMPARED.items()} == before
    one(1, SECOND[1:])
    assert read_stream_lake(spark, out)["files"].count() == 3


def test_compaction_keeps_the_tables_and_the_stream_goes_on(spark, tmp_path):
    from edgeloom.streaming import store as ST

    log, out = shuffled_log(3), str(tmp_path / "stream")
    stream(spark, tmp_path, log[:6], log[6:12])
    before = {name: rows(read_stream_lake(spark, out)[name], *columns) for name, columns in COMPARED.items()}
    assert ST.compact(spark, out) == 1 and ST.compact(spark, out) == 1
    ST.drop_compacted(spark, out)
    assert {name: rows(read_stream_lake(spark, out)[name], *columns) for name, columns in COMPARED.items()} == before
    assert not list((tmp_path / "stream" / "edges").glob("batch_id=*"))
    files = [p for p in (tmp_path / "stream" / "compacted" / "1" / "assets").rglob("*.parquet")]
    assert 0 < len(files) <= 2  # one per run bucket at most
    (tmp_path / "landing" / "9.json").write_text("\n".join(log[12:]) + "\n")
    start_ingest(spark, str(tmp_path / "landing"), out, str(tmp_path / "cp")).awaitTermination()
    streamed = read_stream_lake(spark, out)
    batch = ingest(read_event_lines(spark, str(tmp_path / "landing")), str(tmp_path / "batch"))
    for name, columns in COMPARED.items():
        assert rows(streamed[name], *columns) == rows(batch[name], *columns), name


def test_a_batch_does_not_read_earlier_events(spark, tmp_path):
    """Replays are told by state: the plan that finds the new lines scans what has landed, and nothing stored."""
    from edgeloom.streaming.ingest import unseen

    text = plan(unseen(spark.createDataFrame([(FIRST[0],)], "value string")))
    assert "decoded" not in text and "Join" not in text


def test_appended_lines_arrive_and_equal_lines_differ(spark, tmp_path):
    """Lines of any length and range, an unfinished one that ends later, and files that grow while they are followed."""
    logs = tmp_path / "logs"
    logs.mkdir()
    texts = ["same", "same", "", "x" * 200_000, "é𝒜", "same"]
    (logs / "run-1.log").write_bytes("\n".join(texts).encode())
    (logs / "_hidden.log").write_text("no\n")
    for size in (7, 100, 65_536, 1 << 20):
        ranges = PL._Reader(str(logs), size).partitions()
        ends = ranges if len(ranges) < 80 else ranges[:40] + ranges[-40:]  # between them is the long line alone
        assert [row[2] for r in ends for row in PL.read_range(r)] == texts, size
    got = CL.read_log_files(spark, str(logs), 65_536).orderBy("at").collect()
    assert [r.message for r in got] == texts and len({r.log_id for r in got}) == len(texts)

    def follow():
        start_tail(CL.follow_log_files(spark, str(logs), 65_536), str(tmp_path / "tail"), str(tmp_path / "cp")).awaitTermination()
        return [r.message for r in spark.read.parquet(str(tmp_path / "tail")).orderBy("run_id", "at").collect()]

    assert follow() == texts[:5]  # the last line has not ended
    with (logs / "run-1.log").open("ab") as f:
        f.write(b" line\nnew\n")
    (logs / "run-2.log").write_text("other\n")
    assert follow() == [*texts[:5], "same line", "new", "other"]
    assert follow() == [*texts[:5], "same line", "new", "other"]


def test_many_small_files_share_a_task(spark, tmp_path):
    """Tasks follow the bytes and not the number of files, and each line is still read once, with its file and place."""
    for i in range(600):
        (tmp_path / f"run-{i:03d}.log").write_text(f"first {i}\nsecond {i}\n")
    (tmp_path / "run-900.log").write_text("x" * 99 + "\n" + "y" * (3 << 20) + "\n" + "z\n")
    tasks = PL._Reader(str(tmp_path), 4096).partitions()
    assert len(tasks) < 20 and max(len(t.parts) for t in tasks) <= PL.FILES
    assert max(sum(r.stop - r.start for r in t.parts) for t in tasks) <= PL.LEAST
    got = CL.read_log_files(spark, str(tmp_path), 4096).select("run_id", "at", "message").collect()
    wanted = [(f"run-{i:03d}", at, f"{word} {i}") for i in range(600) for at, word in ((0, "first"), (len(f"first {i}") + 1, "second"))]
    wanted += [("run-900", 0, "x" * 99), ("run-900", 100, "y" * (3 << 20)), ("run-900", 101 + (3 << 20), "z")]
    assert sorted(map(tuple, got)) == sorted(wanted)
