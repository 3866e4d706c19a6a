"""The rules of ingest on small logs with results written by hand."""

from pyspark.sql import functions as F

from edgeloom.operators import ingest_assets as A
from edgeloom.operators import ingest_edges as G
from edgeloom.operators import ingest_files as FI
from edgeloom.sources import events as EV
from edgeloom.sources.replays import decode_lines
from tests.helpers import decoded, edge, event, file_event, ingested, lines, rows, table


def test_whole_example(spark):
    data = {
        "filePath": "models/a.sql", "fileHash": "", "fileType": "JINJA2", "status": "success",
        "tables": [
            {"name": "orders", "role": "source", "columns": [" Id ", "id", "amt"]},
            {"name": "daily", "role": "TARGET", "schema": "mart", "columns": ["day"]},
            {"name": "tmp1", "role": "cte"},
        ],
        "table_edges": [edge("raw.orders", "daily", transformation_lines={"start_line": "L3", "end_line": 9})],
        "lineage": {"column_edges": [edge("orders", "daily", from_column="amt", to_column="day", edge_type=None)]},
    }
    t = ingested(spark, event("file_extraction", "run-7", 12, data))
    assert rows(FI.file_records(t["decoded"]), "file_hash", "file_type", "status") == [("unknown", "JINJA2", "SUCCESS")]
    assert rows(t["assets"], "short_name", "role", "schema_name", "full_name") == [
        ("daily", "TARGET", "mart", "mart.daily"),
        ("orders", "SOURCE", "unknown_schema", "unknown_schema.orders"),
    ]
    assert rows(t["columns"], "short_name", "column_name") == [
        ("daily", "day"), ("orders", "amt"), ("orders", "id"), ("orders", "id"),
    ]
    assert rows(t["lineage"], "edge_type", "from_column", "to_column", "transformation_type", "start_line", "end_line") == [
        ("column_edge", "amt", "day", "UNKNOWN", None, None),
        ("table_edge", None, None, "UNKNOWN", 3, 9),
    ]
    assert t["links"].count() == 6
    ids = [r[0] for r in t["links"].select("asset_file_id").collect()]
    assert len(set(ids)) == 6


def test_edge_before_its_table_is_skipped_and_kept_afterwards(spark):
    t = ingested(
        spark,
        file_event("r", 1, tables=[table("a")], lineageEdges=[edge("a", "b")]),
        file_event("r", 2, tables=[table("b", "target")]),
        file_event("r", 3, lineageEdges=[edge("a", "b")]),
    )
    assert rows(t["lineage"], "event_seq") == [(3,)]
    assert rows(G.skipped_edges(t["resolved"]), "event_seq", "skip_reason") == [(1, "to_unknown")]
    assert rows(G.repair_edges(t["resolved"], t["assets"]), "event_seq", "to_full") == [(1, "unknown_schema.b")]


def test_dotted_tables_are_not_met_by_their_edges(spark):
    log = [file_event("r", 1, tables=[table("a.b"), table("c")], lineageEdges=[edge("a.b", "c"), edge("x.b", "c")])]
    t = ingested(spark, *log)
    assert t["lineage"].count() == 0
    assert rows(t["assets"], "short_name", "schema_name", "full_name")[0] == ("a.b", "a", "a.a.b")
    d = decoded(spark, *log)
    assets = A.first_assets(A.asset_mentions(d, "last_part"))
    assert G.resolve_edges(G.edge_mentions(d), assets, "inner").count() == 2


def test_ends_match_by_case(spark):
    t = ingested(spark, file_event("r", 1, tables=[table("Orders"), table("x")], lineageEdges=[edge("orders", "x")]))
    assert rows(G.skipped_edges(t["resolved"]), "skip_reason") == [("from_unknown",)]


def test_first_mention_decides(spark):
    t = ingested(
        spark,
        file_event("r", 2, tables=[table("t", "target", schema="s2", columns=["b", "A"])]),
        file_event("r", 1, tables=[table("t", "source", schema="s1", columns=["a"])]),
        file_event("r", 3, tables=[table("t", "target", columns=["b", "c", "C "])]),
        file_event("q", 9, tables=[table("t", "target", schema="other")]),
    )
    assert rows(t["assets"], "run_id", "role", "schema_name", "first_seq") == [
        ("q", "TARGET", "other", 9), ("r", "SOURCE", "s1", 1),
    ]
    assert rows(t["columns"].filter("run_id = 'r'"), "role", "column_name") == [
        ("SOURCE", "a"), ("TARGET", "a"), ("TARGET", "b"), ("TARGET", "c"), ("TARGET", "c"),
    ]


def test_merge_fills_nulls_only(spark):
    ddl = (
        "asset_id string, run_id string, full_name string, short_name string, schema_name string, role string, "
        "created_at timestamp_ntz, first_seq bigint, first_tie bigint, first_pos int"
    )
    old = spark.createDataFrame([("i", "r", None, "t", None, "SOURCE", None, 1, 0, 0)], ddl)
    new = spark.createDataFrame([("i", "r", "s.t", "t", "s", "TARGET", None, 2, 0, 0)], ddl)
    assert rows(A.merge_assets(old, new), "full_name", "schema_name", "role", "first_seq") == [("s.t", "s", "SOURCE", 1)]


def test_intermediate_tables_are_not_stored(spark):
    t = ingested(spark, file_event("r", 1, tables=[table("a"), table("tmp", "cte")], lineageEdges=[edge("a", "tmp")]))
    assert rows(t["assets"], "short_name") == [("a",)]
    assert t["lineage"].count() == 0


def test_default_edge_types(spark):
    three = [edge("a", "b"), edge("a", "b", edge_type=None), edge("a", "b", edge_type="column_lineage")]
    two = [edge("a", "b"), edge("a", "b", edge_type="table")]
    t = ingested(
        spark,
        file_event(
            "r", 1, tables=[table("a"), table("b")], lineageEdges=three, table_edges=three, column_edges=two,
            lineage={"table_edges": two, "column_edges": three},
        ),
    )
    kinds = [k.split("_")[0] for (_, k) in rows(t["lineage"].withColumn("p", F.lpad("pos", 2, "0")), "p", "edge_type")]
    assert kinds == (
        ["table", "table", "column"] + ["table", "table", "column"] + ["column", "table"]
        + ["table", "table"] + ["column", "column", "column"]
    )


def test_bad_values_go_to_quarantine_alone(spark):
    d = decoded(
        spark,
        file_event(
            "r", 1, tables=[table("a"), table(5), 7, None, table("b", columns=["x", 3, None]), table("c", columns="text")],
            lineageEdges=[edge("a", "b"), edge(5, "b"), "x", edge("a", ".."), edge("a", "b", transformation_lines=4)],
        ),
        "no json",
        "[1]",
        event("nothing", "r", 2, {}),
        event("progress_update", " ", 3, {}),
        event("progress_update", "r", 4, {}, time="2024-01-01T10:00:00Z"),
        event("file_extraction", "r", 5, "text"),
        event("file_extraction", "r", 6, {"filePath": 3}),
    )
    assert rows(EV.quarantine(d), "item", "pos", "reason") == sorted(
        [
            ("table", 1, "bad_text:name"), ("table", 2, "table_not_object"), ("table", 3, "table_not_object"),
            ("columns", 4, "bad_text:columns"), ("edge", 1, "bad_text:from_table"), ("edge", 2, "edge_not_object"),
            ("edge", 3, "dots_only_name"), ("edge", 4, "lines_not_object"), ("event", None, "not_json"),
            ("event", None, "not_json"), ("event", None, "unknown_event_type"), ("event", None, "bad_run_id"),
            ("event", None, "bad_timestamp"), ("event", None, "bad_payload"), ("event", None, "bad_text:filePath"),
        ],
        key=repr,
    )
    mentions = A.asset_mentions(d)
    assert rows(mentions, "short_name") == [("a",), ("b",), ("c",)]
    assert rows(A.first_columns(A.column_mentions(mentions)), "column_name") == [("x",)]
    assert rows(G.edge_mentions(d), "pos") == [(0,)]


def test_replays_are_dropped(spark):
    one = file_event("r", 1, tables=[table("a")])
    d = decode_lines(lines(spark, one, one, one, file_event("r", 2, tables=[table("a")])))
    assert rows(d, "event_seq") == [(1,), (2,)]
    assert decode_lines(lines(spark, one, one), replays=False).count() == 2


def test_lines_without_sequence_are_ordered_by_time(spark):
    import json

    def no_seq(time, name):
        return json.dumps({
            "eventType": "file_extraction", "runId": "r", "timestamp": time,
            "data": {"tables": [{"name": "t", "role": "source", "schema": name}]},
        })

    late, early = no_seq("2024-01-01T00:00:01", "late"), no_seq("2024-01-01T00:00:00.5", "early")
    t = ingested(spark, late, early, late)
    assert rows(t["assets"], "schema_name") == [("early",)]
    assert t["decoded"].count() == 2


def test_another_event_under_a_key_in_use_is_set_aside(spark):
    """Equal text is a replay; other text is not, and may not vanish."""
    first, other = file_event("r", 1, fileHash="a"), file_event("r", 1, fileHash="b")
    d = decoded(spark, first, other, first, other)
    assert sorted(r.reason or "" for r in d.collect()) == ["", "key_conflict"]
    assert rows(EV.quarantine(d), "item", "reason", "line") == [("event", "key_conflict", max(first, other))]
