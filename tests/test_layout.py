"""What the stored tables and logs cost on disk: ids are made after the shuffle, and what is written is packed."""

import glob
import os

import pyarrow.parquet as pq

from edgeloom.operators import catalog as CA
from edgeloom.operators import ingest_assets as A
from edgeloom.operators import ingest_edges as G
from edgeloom.operators import ingest_files as FI
from edgeloom.operators import lineage as LI
from edgeloom.plans import ingest as I
from edgeloom.sources import names as N
from edgeloom.sources import replays as R
from edgeloom.sources import tables as T
from edgeloom.streaming import ingest as S
from edgeloom.workload import fixtures as X
from tests.helpers import edge, file_event, lines, table

IDS = {"asset_files": A.link_ids, "asset_columns": A.column_ids, "files": FI.file_ids, "lineage": G.edge_ids}


def lineitems(spark, tmp_path):
    rows = [
        (o, p, s, n, float(n), flag, "F" if n % 2 else "O")
        for o, p, s, n, flag in [(1, 7, 3, 1, "A"), (1, 8, 3, 2, "R"), (1, 9, 4, 1, "N"), (2, 7, 3, 5, "A"), (None, 7, 3, 1, "A"), (None, 8, None, 2, "R")]
    ]
    shape = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, shape).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_events_are_built_with_one_shuffle(spark, tmp_path):
    events = X.file_event_lines(spark, lineitems(spark, tmp_path))
    plan = events._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    made = {r.event_seq: [v for q, v in events.collect() if q == r.event_seq] for r in events.collect()}
    assert {k: len(v) for k, v in made.items()} == {1: 2, 2: 1, None: 2}
    both = next(v for v in made[1] if '"run-3"' in v)
    assert both.index('"tbl_7"') < both.index('"tbl_8"')


def test_logs_and_tables_are_packed_and_ids_follow_the_shuffle(spark, tmp_path, monkeypatch):
    log = f"{tmp_path}/log"
    monkeypatch.setattr(X, "place", lambda *a: log)
    X.file_log.__wrapped__(spark, lineitems(spark, tmp_path))
    assert glob.glob(f"{log}/*.gz") and not glob.glob(f"{log}/*.txt")

    moved = {}
    write_table = I.write_table
    monkeypatch.setattr(I, "write_table", lambda df, path, name, *a, **k: (moved.setdefault(name, df.columns), write_table(df, path, name, *a, **k)))
    text = file_event("p", 1, tables=[table("a", columns=["x", "x"]), table("b")], lineageEdges=[edge("a", "b"), edge("a", "gone")])
    lake = I.ingest(lines(spark, text), f"{tmp_path}/lake")
    for name, ids in IDS.items():
        assert not set(ids()) & set(moved[name])
    for name in I.TABLES:
        for file in glob.glob(f"{tmp_path}/lake/{name}/**/*.parquet", recursive=True):
            groups = pq.ParquetFile(file).metadata
            assert name == "quarantine" or not groups.num_rows or groups.row_group(0).column(0).compression == "ZSTD"

    # The ids are those that the operators give.
    mentions = A.asset_mentions(lake["decoded"])
    pairs = [
        (lake["asset_columns"], A.first_columns(A.column_mentions(mentions))),
        (lake["asset_files"], A.asset_links(mentions, lake["lineage"])),
        (lake["files"], FI.file_records(lake["decoded"])),
        (lake["edges"], G.resolve_edges(G.edge_mentions(lake["decoded"]), lake["assets"])),
    ]
    for got, want in pairs:
        assert want.count() and sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_the_shuffle_of_mentions_moves_the_columns_of_the_table(spark, tmp_path):
    plan = X.file_event_lines(spark, lineitems(spark, tmp_path))._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning", 1)[1].split("\n", 1)[1]
    assert "l_quantity" in below and "concat(" not in below and "CASE" not in below



def test_a_long_log_lands_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "LINES_PER_FILE", 3)
    log = f"{tmp_path}/log"
    monkeypatch.setattr(X, "place", lambda *a: log)
    rows = "id AS event_id, 'signup' AS event_type, id AS user_id, 1.0D AS value, '' AS props, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts"
    spark.range(1, 11, numPartitions=1).selectExpr(*rows.split(", ")).write.parquet(f"{tmp_path}/events.parquet")
    X.run_log.__wrapped__(spark, str(tmp_path))
    assert len(glob.glob(f"{log}/*.gz")) == 4
    assert spark.read.text(log).count() == 10


def test_ids_are_made_by_reading(spark, tmp_path):
    text = file_event("p", 1, tables=[table("a", columns=["x"]), table("b")], lineageEdges=[edge("a", "b")])
    lake = I.ingest(lines(spark, text), f"{tmp_path}/lake")
    for name, ids in IDS.items() | {("assets", A.asset_ids)}:
        name = "edges" if name == "lineage" else name
        assert lake[name].count() and not lake[name].filter(" OR ".join(f"{c} IS NULL" for c in ids())).count()
        for file in glob.glob(f"{tmp_path}/lake/{name}/**/*.parquet", recursive=True):
            assert not set(ids()) & set(pq.ParquetFile(file).schema_arrow.names)


def test_stored_ids_are_read_as_they_are(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "a1", "r", "t", "x"), (None, None, "r", "t", "y")], "asset_column_id string, asset_id string, run_id string, short_name string, column_name string")
    T.write_table(rows, f"{tmp_path}/c", "asset_columns")
    got = T.read_table(spark, f"{tmp_path}/c", "asset_columns")
    assert got.columns == T.schema("asset_columns").names
    assert {(r.asset_column_id, r.asset_id) for r in got.collect()} == {("c1", "a1"), (None, None)}


def test_a_table_is_written_when_it_is_asked_for(spark, tmp_path):
    """Only the asked table and those it follows from are written, with the rows that the whole ingest gives them."""
    tables = [table("a", columns=["x"]), table("b", "target")]
    text = [file_event("r", n, tables=tables, table_edges=[edge("a", "b"), edge("a", "gone")]) for n in range(5)]
    whole = I.ingest(lines(spark, *text), f"{tmp_path}/whole")
    for name, written in (("decoded", set()), ("asset_columns", {"asset_columns"}), ("lineage", {"assets", "edges"}), ("asset_files", {"assets", "edges", "asset_files"})):
        lake = I.Lake(lines(spark, *text), f"{tmp_path}/{name}")
        assert sorted(map(str, lake[name].collect())) == sorted(map(str, whole[name].collect())) and lake[name].count()
        assert set(os.listdir(f"{tmp_path}/{name}")) == written | {"decoded"}
    assert set(lake) == set(whole) and all(lake[name].count() == whole[name].count() for name in lake)


def test_what_follows_from_decoded_events_is_not_shuffled(spark, tmp_path):
    """Rows of a run lie together: assets, columns and the ends of edges are found without moving the decoded events."""
    tables = [table("a", columns=["x"]), table("b", "target")]
    text = [file_event(f"r{n % 3}", n, tables=tables, table_edges=[edge("a", "b"), edge("a", "gone")]) for n in range(9)]
    lake = I.Lake(lines(spark, *text), f"{tmp_path}/lake")
    assets, decoded = lake["assets"], spark.table(lake.table)
    named = A.asset_mentions(decoded)
    resolved = G.edge_parts(G.edge_mentions(decoded), assets.hint("merge"))
    counts = decoded.groupBy("run_id", "event_seq", "event_tie").count()
    for df, moved in ((A.first_assets(named), 0), (A.column_parts(A.column_mentions(named)), 0), (counts, 0), (resolved, 2)):
        plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == moved
    assert lake["edges"].count() == 18 and lake["lineage"].count() == 9
    folders = glob.glob(f"{tmp_path}/lake/assets/run_bucket=*")  # one file per bucket of runs
    assert folders and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)
    assert decoded.count() == lake["decoded"].count() == 9


def test_lines_of_an_event_are_put_together_without_a_shuffle(spark, tmp_path, monkeypatch):
    log = f"{tmp_path}/log"
    monkeypatch.setattr(X, "place", lambda *a: log)
    sf = lineitems(spark, tmp_path)
    made = []
    monkeypatch.setattr(X, "land", lambda lines, path: made.append(lines))
    X.file_log.__wrapped__(spark, sf)
    assert "Exchange" not in made[0]._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, made[0].collect())) == sorted(map(str, X.file_event_lines(spark, sf).collect()))


def test_a_log_with_replays_is_decoded_again_without_them(spark, tmp_path):
    once, other = (file_event("r", n, tables=[table("a")]) for n in (1, 2))
    for texts, repeats, rows in (
        ([once, other, "no json"], False, 3),
        ([once, once, other], True, 2),
        ([once, once + " ", other], True, 3),
        ([once, "no json", "no json"], True, 2),
    ):
        out = f"{tmp_path}/{abs(hash(tuple(texts)))}"
        assert R.has_repeats(R.decode_lines(lines(spark, *texts), replays=False)) == repeats
        lake = I.Lake(lines(spark, *texts), out)
        want = R.decode_lines(lines(spark, *texts))
        assert lake["decoded"].count() == rows and spark.table(lake.table).count() == rows
        cols = ["run_id", "event_seq", "reason", "line"]
        assert sorted(map(str, lake["decoded"].select(cols).collect())) == sorted(map(str, want.select(cols).collect()))


def test_copies_by_name_hold_no_ids_and_are_written_when_asked_for(spark, tmp_path):
    """Each question by name has its own copy written, packed and without what follows from other columns."""
    text = [file_event(f"r{n}", n, tables=[table("a"), table("B", "target")], lineageEdges=[edge("a", "B"), edge("B", "B")]) for n in range(3)]
    lake = I.Lake(lines(spark, *text), f"{tmp_path}/lake")
    copies = N.ByName(spark, lake, f"{tmp_path}/copies")

    def all_rows(df, columns):
        return sorted(str(r) for r in df.select(*columns).collect())

    want = CA.assets_by_name(lake["assets"]).drop("run_bucket")
    assert all_rows(copies["assets"], want.columns) == all_rows(want, want.columns) and want.count() == 6
    assert os.listdir(f"{tmp_path}/copies") == ["assets_by_name"] and "edges" not in os.listdir(f"{tmp_path}/lake")
    for side in ("upstream", "downstream"):
        want = LI.seen_from(lake["lineage"], side).drop("run_bucket")
        assert all_rows(copies[side], want.columns) == all_rows(want, want.columns) and want.count() == 6
        if side == "upstream":
            assert os.listdir(f"{tmp_path}/copies/edges_by_name") == ["direction=upstream"]
    want = LI.seen_from(lake["lineage"]).drop("run_bucket")
    assert all_rows(copies["lineage"], want.columns) == all_rows(want, want.columns)
    for file in glob.glob(f"{tmp_path}/copies/**/*.parquet", recursive=True):
        held = pq.ParquetFile(file)
        assert not {"asset_id", *G.edge_ids(), "neighbor", "neighbor_full"} & set(held.schema_arrow.names)
        assert held.metadata.row_group(0).column(0).compression == "ZSTD"


def test_tables_of_a_stream_hold_no_ids(spark, tmp_path):
    """Batches of a stream are stored packed and without ids; reading makes those that a batch ingest has."""
    name = lambda n: table(f"t{n}", columns=["x", "x"])
    text = [file_event("r", n, tables=[name(n), name(n + 1)], lineageEdges=[edge(f"t{n}", f"t{n + 1}"), edge("t9", "t0")]) for n in range(9)]
    for i, part in enumerate((text[4:], text[:4])):  # the late events bring first mentions
        lines(spark, *part).coalesce(1).write.text(f"{tmp_path}/landing/{i}")
        S.start_ingest(spark, f"{tmp_path}/landing/*", f"{tmp_path}/stream", f"{tmp_path}/checkpoint").awaitTermination()
    got, want = S.read_stream_lake(spark, f"{tmp_path}/stream"), I.ingest(lines(spark, *text), f"{tmp_path}/batch")
    assert got["edge_fixes"].count()
    for of, ids in (IDS | {"assets": A.asset_ids}).items():
        columns = [c for c in want[of].columns if c not in ("run_bucket", "first_tie")]
        a, b = (sorted(str(r) for r in df[of].select(*columns).collect()) for df in (got, want))
        assert a and a == b and all(f"{c}='" in a[0] for c in ids())
        files = glob.glob(f"{tmp_path}/stream/{'edges' if of == 'lineage' else of}/batch_id=*/*.parquet")
        held = [pq.ParquetFile(f) for f in files]
        assert held and not any(set(ids()) & set(f.schema_arrow.names) for f in held)
        assert {f.metadata.row_group(0).column(0).compression for f in held if f.metadata.num_rows} == {"ZSTD"}
