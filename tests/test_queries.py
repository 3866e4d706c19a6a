"""Lineage, entity, catalogue and paging rules on small tables."""

import json

from pyspark.sql import functions as F

from edgeloom.operators import catalog as CA
from edgeloom.operators import entities as EN
from edgeloom.operators import files as FI
from edgeloom.operators import lineage as LI
from edgeloom.operators import logs as LO
from edgeloom.operators.common import page_after, top_k
from edgeloom.plans import nested as NE
from tests.helpers import edge, file_event, ingested, rows, table


def small(spark):
    """Two runs; `T` and `t` are one name; the newest `t` is that of run q."""
    return ingested(
        spark,
        file_event(
            "p", 1, tables=[table("a"), table("T", "target", columns=["y"]), table("b")],
            lineageEdges=[
                edge("a", "T", transformation_lines={"start_line": 1}),
                edge("a", "T", transformation_lines={"start_line": 1}),
                edge("b", "T", edge_type="column_edge", from_column="c"),
                edge("T", "T", edge_type="column_edge", from_column="y", to_column="y"),
            ],
        ),
        file_event(
            "q", 2, tables=[table("a"), table("t", "target", columns=["z", "Z"])],
            column_edges=[edge("a", "t", from_column="k", to_column="z"), edge("a", "t", from_column="k", to_column="z"),
                          edge("a", "t", from_column=" ", to_column=None), edge("t", "t", from_column="z", to_column="z")],
        ).replace("10:00:00", "11:00:00"),
    )


def test_names_join_over_runs_and_entities_do_not(spark):
    s = small(spark)
    up = LI.neighbours(s["assets"], s["lineage"], "upstream", ["T"])
    assert rows(up, "entity_id", "neighbor", "n_edges") == [("t", "T", 1), ("t", "a", 5), ("t", "b", 1), ("t", "t", 1)]
    got = EN.entities(s["assets"], s["lineage"], s["columns"], ["t"])
    assert rows(got, "entity_id", "upstream_count", "downstream_count", "column_count", "has_downstream") == [
        ("t", 4, 1, 2, True)
    ]
    assert rows(EN.target_columns(s["assets"], s["columns"], "T"), "column_name", "column_type") == [
        ("z", "varchar"), ("z", "varchar"),
    ]


def test_transformations_and_pairs(spark):
    s = small(spark)
    got = LI.transformations(s["assets"], s["lineage"], "upstream", "t").filter("neighbor = 'a'")
    assert rows(got, "file_id", "start_line", "end_line") == [("f1.sql", 1, None), ("f2.sql", None, None)]
    pairs = LI.column_lineage(s["assets"], s["lineage"], "upstream", "t")
    assert rows(pairs, "from_entity", "from_column", "to_entity", "to_column") == [
        ("T", "y", "t", "y"), ("a", "k", "t", "z"), ("b", "c", "t", None), ("t", "z", "t", "z"),
    ]
    own = EN.entity_pairs(s["assets"], s["lineage"], "t")
    assert rows(own, "direction", "from_entity", "from_column", "to_column") == [
        ("upstream", "a", "k", "z"), ("upstream", "t", "z", "z"),
    ]


def test_answers_have_one_grain(spark):
    s = small(spark)
    answers = NE.lineage_answers(s["assets"], s["lineage"])
    by_item = {}
    for r in NE.answers_as_json(answers).collect():
        by_item.setdefault((r.entity_id, r.direction, r.item), []).append(json.loads(r.answer))
    nodes = by_item[("t", "upstream", "neighbour")]
    assert sorted({n["lineage"]["entityId"] for n in nodes}) == ["T", "a", "b", "t"]
    assert {
        "fileId": "f1.sql", "transformation_type": "UNKNOWN", "lines": {"start_line": 1, "end_line": None},
    } in [t for n in nodes if n["lineage"]["entityId"] == "a" for t in n["lineage"]["transformations"]]
    pairs = by_item[("t", "upstream", "pair")]
    assert [{"urn": "t", "path": None, "transformation": None}] in [p["fineGrainedLineages"]["downstreams"] for p in pairs]
    assert len(by_item[("a", "upstream", "entity")]) == 1 and ("a", "upstream", "neighbour") not in by_item

    steps = answers.select(F.explode("lineage.transformations"))
    assert steps.count() == LI.transformations(s["assets"], s["lineage"]).count()
    assert answers.filter("item = 'pair'").count() == LI.column_lineage(s["assets"], s["lineage"]).count()
    document = NE.as_document(answers.filter("entityId = 't' AND direction = 'upstream'")).first()
    assert document.entityName and len(document.lineage) == len(nodes) and len(document.fineGrainedLineages) == len(pairs)

    entity = [json.loads(r.answer) for r in NE.answers_as_json(NE.entity_answers(s["assets"], s["lineage"], s["columns"], "t")).collect()]
    fields = [e["fields"] for e in entity if e["fields"]]
    assert [f["path"] for f in fields] == ["z", "z"] and fields[0]["nativeDataType"] == "varchar"
    assert sum(e["columnCount"] is not None for e in entity) == 1


def test_edge_detail(spark):
    s = small(spark)
    got = [json.loads(r.answer) for r in NE.edge_details_as_json(LI.edge_details(s["lineage"])).collect()]
    assert len(got) == 8
    assert {g["lines"]["end_line"] for g in got if g["lines"]} == {None}


def test_bulk_keeps_order_and_repeats(spark):
    s = small(spark)
    asked = spark.createDataFrame([(0, "T"), (1, "nope"), (2, "a"), (3, "t")], "position int, entity_id string")
    got = EN.bulk_entities(s["assets"], s["lineage"], s["columns"], asked)
    assert rows(got, "position", "asked_id", "entity_id") == [(0, "T", "t"), (2, "a", "a"), (3, "t", "t")]
    assert rows(LI.unknown_names(s["assets"], asked.select("entity_id")), "entity_id") == [("nope",)]


def test_detail_mixes_own_role_with_newest_counts(spark):
    s = small(spark)
    got = EN.asset_details(s["assets"], s["lineage"], s["columns"]).filter("lower(short_name) = 't'")
    assert rows(got, "short_name", "role", "upstream_count") == [("t", "TARGET", 4), ("t", "TARGET", 4)]


def test_search(spark):
    s = small(spark)
    assert rows(CA.search(s["assets"], [" A ", "_", "%", "", "  "], limit=2), "query", "entity_id", "rn") == [
        (" A ", "T", 1), (" A ", "a", 2), ("_", "T", 1), ("_", "a", 2),
    ]
    assert CA.search(s["assets"], []).count() == 0


def test_list_assets_clamps_pages(spark):
    s = small(spark)
    got = CA.list_assets(s["assets"], s["lineage"], s["links"], q=" ", page_no=1, size=3)
    assert rows(got, "short_name", "total_elements", "total_pages") == [("b", 5, 2), ("t", 5, 2)]
    assert CA.list_assets(s["assets"], s["lineage"], s["links"], page_no=9, size=3).count() == 0
    first = s["assets"].orderBy("short_name", "asset_id").select("short_name", "asset_id").first()
    rest = page_after(s["assets"], ["short_name", "asset_id"], list(first), 10)
    assert rest.count() == 4


def test_paths_with_several_rows_are_reported(spark):
    df = spark.createDataFrame([(1, "r", "p"), (2, "r", "p"), (3, "r", "q")], "file_id int, run_id string, file_path string")
    assert rows(FI.file_by_path(df), "file_id") == [(3,)]
    assert rows(FI.ambiguous_paths(df), "file_path", "n_rows") == [("p", 2)]


def test_top_k_with_one_hot_key(spark):
    """A key with most of the rows: the two-step cut gives what one sort gives."""
    n = 20000
    key = F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
    df = spark.range(n).select("id", key.alias("run_id"), ((F.col("id") * 7919) % 1000).alias("v"))
    got = top_k(df, ["run_id"], [F.desc("v"), F.asc("id")], 5, salt="id", ways=4)
    data: dict[str, list] = {}
    for i in range(n):
        k = "hot" if i % 3 > 0 else f"k{i % 50}"
        data.setdefault(k, []).append((-((i * 7919) % 1000), i))
    want = sorted((k, i, r + 1) for k, v in data.items() for r, (_, i) in enumerate(sorted(v)[:5]))
    assert sorted(tuple(r) for r in got.select("run_id", "id", "rn").collect()) == want


def test_log_page_of_a_run(spark):
    logs = spark.createDataFrame([(i, "r", None) for i in range(7)], "log_id int, run_id string, x string").select(
        "log_id", "run_id", F.lit("2024-01-01T00:00:00").cast("timestamp_ntz").alias("log_time")
    )
    assert rows(LO.log_page(logs, page_no=1, size=3, ids="r"), "log_id", "rn", "total") == [(1, 6, 7), (2, 5, 7), (3, 4, 7)]
    assert LO.log_page(logs, ids=["other"]).count() == 0


def test_ranked_pages_meet_any_page(spark, tmp_path):
    from edgeloom.operators.paging import RankedTable, write_ranked

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(500).selectExpr("id", "CASE WHEN id % 3 > 0 THEN 'hot' ELSE concat('k', id % 7) END AS k", "id % 5 AS v").repartition(3)
        order = [F.desc("v"), F.asc("id")]
        for by, out in (((), str(tmp_path / "all")), (("k",), str(tmp_path / "keyed"))):
            write_ranked(df, order, out, by)
            ranked = RankedTable(spark, out, order)
            assert ranked.rows.select("part").distinct().count() > 1
            for key in ([{}] if not by else [{"k": "hot"}, {"k": "k3"}, {"k": "none"}]):
                want = [r.id for r in (df if not key else df.filter(F.col("k") == key["k"])).orderBy(*order).collect()]
                assert ranked.total(**key) == len(want)
                for page_no in (0, 1, 7, 16, 100):
                    got = ranked.page(page_no, 30, **key).collect()
                    assert [r.id for r in got] == want[page_no * 30 : page_no * 30 + 30]
                    assert all(r.total_elements == len(want) for r in got)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_search_over_the_index_finds_what_a_scan_finds(spark, tmp_path):
    from edgeloom.operators.name_search import read_name_index, search_names, write_name_index

    names = ["Orders", "order_items", "a", "ab", "%_x", "x%", "aaaa", "É_Tab", "tab.É", None, ""]
    rows = [(f"id{i}", n, None if n is None else f"db.{n}", i) for i, n in enumerate(names)]
    assets = spark.createDataFrame(rows, "asset_id string, short_name string, full_name string, created_at long")
    write_name_index(assets, str(tmp_path / "index"))
    texts = ["order", " ORDER ", "a", "aa", "aaa", "%", "_", "é", "É_t", "", "  ", "db.", "nothing", "b.a", None]
    queries = spark.createDataFrame([(t,) for t in texts], "q string")
    found = search_names(assets, read_name_index(spark, str(tmp_path / "index")), queries).collect()
    for text in texts:
        needle = (text or "").strip().lower()
        want = sorted(n for n in names if needle and n is not None and needle in f"db.{n}".lower())
        assert sorted(r.entity_id for r in found if r.query == text) == want, text
    assert search_names(assets, read_name_index(spark, str(tmp_path / "index")), queries, limit=2).groupBy("query").count().filter("count > 2").count() == 0
