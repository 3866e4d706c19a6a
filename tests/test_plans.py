"""What the plans must and must not hold."""

import pytest

from edgeloom.operators import lineage as LI
from edgeloom.plans.ingest import ingest
from edgeloom.workload import QUERIES
from edgeloom.workload import fixtures as X
from tests.helpers import edge, file_event, lines, plan, table

SF = "/root/testdata/sf0.001"


STREAMED = {"str_1", "str_1_conflicts", "str_1_links", "str_2", "str_2_assets", "str_2_columns", "str_3"}


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in STREAMED])
def test_no_cross_join_and_no_python_rows(spark, name):
    text = plan(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_limits_come_before_the_shuffle(spark):
    for name in ("log_3", "col_2"):
        text = plan(QUERIES[name](spark, SF))
        tree = text[: text.index("\n\n\n")]
        assert tree.rindex("WindowGroupLimit") > tree.rindex("Exchange")


def test_run_lookup_prunes_directories_and_pushes_the_run(spark, tmp_path):
    log = [file_event(f"r{i}", i, tables=[table("a"), table("b")], lineageEdges=[edge("a", "b")]) for i in range(5)]
    lineage = ingest(lines(spark, *log), str(tmp_path / "lake"))["lineage"]
    one = LI.edges_of_run(lineage, "r3")
    text = plan(one)
    assert "run_bucket" in text[text.index("PartitionFilters") :].split("\n")[0]
    assert "In(run_id, [r3])" in text or "EqualTo(run_id,r3)" in text
    assert one.count() == 1


def test_scans_read_only_what_is_asked(spark):
    text = plan(QUERIES["lin_2"](spark, SF))
    schemas = [line for line in text.split("\n") if line.startswith("ReadSchema")]
    assert schemas and not any("file_path" in s or "transformation_type" in s for s in schemas)


def test_decoded_branches_do_not_open_other_arrays(spark):
    from edgeloom.operators import ingest_files as FI

    text = plan(FI.file_records(X.lake(spark, SF)["decoded"]))
    assert "edges" not in [s for s in text.split("\n") if s.startswith("ReadSchema")][0]


def test_replays_are_found_without_moving_lines(spark):
    """No text and no payload is shuffled to find replays; lines that are not odd are decoded where they were read."""
    from edgeloom.sources import replays as RE

    log = lines(spark, *[file_event("r", i % 7) for i in range(9)])
    assert RE.odd_lines(log).count() == 2 and RE.odd_lines(log.distinct()) is None
    counted = RE.line_keys(log).groupBy("run_id", "event_seq", "event_tie").count()
    for df in (counted, RE.settled(log, None)):
        for part in plan(df).split("\n\n"):
            if part.strip().startswith("(") and "Exchange" in part.split("\n")[0]:
                assert "value" not in part and "line" not in part and "data" not in part


def test_a_question_by_name_reads_its_directory_and_pushes_the_name(spark):
    copies = X.by_name(spark, SF)
    for df in (LI.edges_into_name(copies["lineage"], "tbl_3"), LI.neighbours(copies["assets"], copies["lineage"], "upstream", ["tbl_3", "Tbl_4"])):
        parts, pushed = ([x for x in plan(df).split("\n") if x.startswith(kind)] for kind in ("PartitionFilters", "PushedFilters"))
        assert parts and all("name_bucket" in x for x in parts)
        assert len(pushed) == len(parts) and all("(name_key" in x for x in pushed)
    assert LI.edges_into_name(copies["lineage"], "tbl_3").count() == LI.edges_into_name(X.lake(spark, SF)["lineage"], "tbl_3").count() > 0


def test_asked_names_prune_while_running(spark):
    copies = X.by_name(spark, SF)
    text = plan(LI.edges_into_name(copies["lineage"], X.asked_names(spark, SF).filter("position < 4").select("asked_id")))
    assert "dynamicpruning" in text.lower()
