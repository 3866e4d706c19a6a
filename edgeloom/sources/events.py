"""The event log: landed JSON lines, one event each, decoded once into typed rows.

`decode` parses each line a single time. Its output has one row per event with the file facts, the table
mentions and the edges as nested typed columns, so a stored copy lets every later step read only its own part.
A value of the wrong JSON type is never coerced: it marks its event, mention or edge with a reason. The `*_any`
columns, in which such values are still visible, are null for the events that have none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import payload as P
from edgeloom.functions import text as T

HEAD_FIELDS = ["eventType", "runId", "podId", "timestamp"]
FILE_FIELDS = ["filePath", "fileUrl", "fileHash", "fileType", "status"]
STARTED_FIELDS = ["repositoryUrl", "branch", "triggeredBy"]
PROGRESS_FIELDS = ["currentFile", "currentPhase"]
COUNTERS = ["totalFiles", "processedFiles", "errorCount"]
TABLE_FIELDS = ["name", "role", "schema"]
EDGE_FIELDS = ["from_table", "to_table", "from_column", "to_column", "edge_type", "transformation_type"]
LINE_FIELDS = ["start_line", "end_line"]

#: Why a line is refused before its payload is looked at: such a line has no dependable key.
REFUSED = ["not_json", "bad_timestamp", "unknown_event_type", "bad_run_id", "no_order"]

# Edge arrays in the order they are read, with the edge type a member gets when it states none.
EDGE_ARRAYS = [
    ("lineageEdges", None),
    ("table_edges", "TABLE_EDGE"),
    ("column_edges", "COLUMN_EDGE"),
    ("lineage.table_edges", "TABLE_EDGE"),
    ("lineage.column_edges", "COLUMN_EDGE"),
]

_SCALARS = [*FILE_FIELDS, *STARTED_FIELDS, *PROGRESS_FIELDS, *COUNTERS, "error"]
_EDGE_TEXTS = ",".join(f"{n}:string" for n in EDGE_FIELDS)
TABLES_SHAPE = "array<struct<name:string,role:string,schema:string,columns:array<string>>>"
EDGES_SHAPE = f"array<struct<{_EDGE_TEXTS},transformation_lines:variant>>"
EDGES_ANY_SHAPE = f"array<struct<{_EDGE_TEXTS}>>"


def _payload_shape(edges: str) -> str:
    arrays = f"table_edges:{edges},column_edges:{edges}"
    scalars = ",".join(f"{n}:string" for n in _SCALARS)
    return f"struct<{scalars},tables:{TABLES_SHAPE},lineageEdges:{edges},{arrays},lineage:struct<{arrays}>>"


def read_event_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_event_lines(spark: SparkSession, path: str, max_files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("text").option("maxFilesPerTrigger", max_files_per_trigger).load(path)


def parse_envelope(lines: DataFrame, *keep: str) -> DataFrame:
    """Envelope fields of each line, beside the columns to keep; `data` stays untyped. Unusable lines carry a `reason`.

    A line without `event_seq` is ordered by its time, then by a hash of the line.
    """
    epoch = F.lit("1970-01-01T00:00:00").cast("timestamp_ntz")
    v = F.col("v")
    typed = (
        lines.select("value", *keep, F.try_parse_json("value").alias("v"))
        .select(
            "value",
            *keep,
            P.text_as(v, "$", P.struct_of(HEAD_FIELDS)).alias("h"),
            P.any_as(v, "$", "struct<timestamp:string>").alias("any_head"),
            P.get(v, "$.event_seq", "bigint").alias("stated_seq"),
            P.get(v, "$.data").alias("data"),
        )
        .withColumn("event_time", P.event_time(F.col("h.timestamp")))
    )
    stated_time, event_type = F.col("h.timestamp"), F.col("h.eventType")
    odd_time = P.is_not_text(stated_time, F.col("any_head.timestamp")) | (
        ~T.is_blank(stated_time) & F.col("event_time").isNull()
    )
    return typed.select(
        F.when(F.col("h").isNull(), "not_json")
        .when(odd_time, "bad_timestamp")
        .when(event_type.isNull() | ~event_type.isin(*C.EVENT_TYPES), "unknown_event_type")
        .when(T.is_blank(F.col("h.runId")), "bad_run_id")
        .when(F.col("stated_seq").isNull() & F.col("event_time").isNull(), "no_order")
        .alias("reason"),
        event_type.alias("event_type"),
        F.col("h.runId").alias("run_id"),
        F.col("h.podId").alias("pod_id"),
        "event_time",
        F.coalesce("stated_seq", F.timestamp_diff("MICROSECOND", epoch, F.col("event_time"))).alias("event_seq"),
        F.when(F.col("stated_seq").isNull(), F.xxhash64("value")).otherwise(F.lit(0)).alias("event_tie"),
        "data",
        F.col("value").alias("line"),
        *keep,
    )


def _joined(form: str, shape: str) -> Column:
    """The five edge arrays as one, one after the other."""
    nothing = F.array().cast(shape)
    return F.concat(*[F.coalesce(f"{form}.{path}", nothing) for path, _ in EDGE_ARRAYS])


def _array_starts(form: str) -> Column:
    """Where each edge array but the first starts in the joined array."""
    starts, total = [], F.lit(0)
    for i, (path, _) in enumerate(EDGE_ARRAYS[:-1], start=1):
        total = total + F.when(F.col(f"{form}.{path}").isNull(), 0).otherwise(F.size(f"{form}.{path}"))
        starts.append(total.alias(f"s{i}"))
    return F.struct(*starts)


def _default_edge_type(pos: Column, starts: Column) -> Column:
    """The type an edge has by the array it stood in."""
    in_array = F.when(pos < starts["s1"], F.lit(EDGE_ARRAYS[0][1]).cast("string"))
    for i, (_, default) in enumerate(EDGE_ARRAYS[1:-1], start=2):
        in_array = in_array.when(pos < starts[f"s{i}"], default)
    return in_array.otherwise(EDGE_ARRAYS[-1][1])


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def decode(envelopes: DataFrame) -> DataFrame:
    """Typed payload of each event, beside its envelope.

    A payload whose own text fields hold something else is set aside as a whole, as is a start or file event
    whose payload is no object. `makes_run` says whether the event brings its run into being all the same.
    """
    kind = F.col("event_type")
    progress = kind.isin(C.PROGRESS_UPDATE, C.JOB_STATUS_UPDATE)
    is_file = kind == C.FILE_EXTRACTION
    data = F.col("data")
    # Two casts open the payload: `b` holds text only, still as bytes, `a` holds any value spelt out.
    opened = envelopes.select(
        "*",
        P.any_as(data, "$", P.in_binary(_payload_shape(EDGES_SHAPE))).alias("b"),
        P.any_as(data, "$", _payload_shape(EDGES_ANY_SHAPE)).alias("a"),
    ).select(
        *envelopes.columns,
        "a",
        F.struct(*[F.col(f"b.{n}").cast("string").alias(n) for n in _SCALARS]).alias("t"),
        F.when(is_file, F.col("b.tables").cast(TABLES_SHAPE)).alias("tables"),
        F.when(is_file, _joined("b", P.in_binary(EDGES_SHAPE)).cast(EDGES_SHAPE)).alias("edges"),
        F.when(is_file, _joined("a", EDGES_ANY_SHAPE)).alias("edges_any"),
        F.when(is_file, _array_starts("b")).alias("edge_starts"),
    )

    payload_reason = F.when(kind.isin(C.RUN_STARTED, C.FILE_EXTRACTION) & F.col("a").isNull(), "bad_payload")
    for names, when in (
        (FILE_FIELDS, is_file),
        (STARTED_FIELDS, kind == C.RUN_STARTED),
        (PROGRESS_FIELDS, progress),
        (["error"], kind == C.RUN_FAILED),
    ):
        for n in names:
            payload_reason = payload_reason.when(when & P.is_not_text(F.col(f"t.{n}"), F.col(f"a.{n}")), f"bad_text:{n}")

    odd_edges = F.lit(False)
    for n in EDGE_FIELDS:
        odd_edges = odd_edges | _differs(F.col(f"edges.{n}"), F.col(f"edges_any.{n}"))

    judged = opened.withColumn("whole_reason", F.coalesce("reason", payload_reason))
    ok = F.col("whole_reason").isNull()

    def part(names: list[str]) -> Column:
        return F.struct(*[F.col(f"t.{n}").alias(n) for n in names])

    return judged.select(
        *C.EVENT_KEY,
        "event_type",
        "pod_id",
        "event_time",
        F.col("whole_reason").alias("reason"),
        (F.col("reason").isNull() & (ok | ~kind.isin(C.RUN_STARTED, C.RUN_FAILED))).alias("makes_run"),
        F.when(ok & is_file, part(FILE_FIELDS)).alias("file"),
        F.when(ok, F.col("tables")).alias("tables"),
        F.when(ok & is_file & _differs(F.col("tables"), F.col("a.tables")), F.col("a.tables")).alias("tables_any"),
        F.when(ok, F.col("edges")).alias("edges"),
        F.when(ok & odd_edges, F.col("edges_any")).alias("edges_any"),
        F.when(ok, F.col("edge_starts")).alias("edge_starts"),
        F.when(ok & (kind == C.RUN_STARTED), part(STARTED_FIELDS)).alias("started"),
        F.when(
            ok & progress,
            F.struct(
                *[F.col(f"t.{n}").alias(n) for n in PROGRESS_FIELDS],
                *[P.number_to_int(F.col(f"t.{n}"), F.col(f"a.{n}")).alias(n) for n in COUNTERS],
            ),
        ).alias("progress"),
        F.when(ok & (kind == C.RUN_FAILED), F.col("t.error")).alias("error"),
        F.when(
            ok & (kind == C.RUN_COMPLETED) & P.is_object(data, "$.stats"), P.get(data, "$.stats")
        ).alias("stats"),
        F.when(~ok, F.col("line")).alias("line"),
    )


def unnest_members(decoded: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per member of `tables`, with its position, its fields and what is `bad` about it."""
    some = decoded.filter(F.size("tables") > 0)
    some = some.withColumn("tables_any", F.coalesce("tables_any", F.array().cast(TABLES_SHAPE)))
    rows = some.select(*C.EVENT_KEY, *keep, F.posexplode(F.arrays_zip("tables", "tables_any")).alias("pos", "m"))
    t, a = F.col("m.tables"), F.col("m.tables_any")
    bad = F.when(t.isNull(), "table_not_object")
    for n in TABLE_FIELDS:
        bad = bad.when(P.is_not_text(t[n], a[n]), f"bad_text:{n}")
    odd_column = a.isNotNull() & _differs(t["columns"], a["columns"])
    return rows.withColumns({"bad": bad, "has_bad_column": odd_column}).select(
        *[c for c in rows.columns if c != "m"], "m.tables.*", "bad", "has_bad_column"
    )


def unnest_edge_members(decoded: DataFrame, *keep: str | Column) -> DataFrame:
    """One row per member of the five edge arrays; a missing or null edge type takes that of its array."""
    some = decoded.filter(F.size("edges") > 0)
    some = some.withColumn("edges_any", F.coalesce("edges_any", F.array().cast(EDGES_ANY_SHAPE)))
    members = F.arrays_zip("edges", "edges_any")
    rows = some.select(*C.EVENT_KEY, *keep, "edge_starts", F.posexplode(members).alias("pos", "m"))
    t, a = F.col("m.edges"), F.col("m.edges_any")
    lines = t["transformation_lines"]
    shape = P.struct_of(LINE_FIELDS)
    rows = rows.withColumns({"lt": P.text_as(lines, "$", shape), "la": P.any_as(lines, "$", shape)})
    bad = F.when(t.isNull(), "edge_not_object")
    for n in EDGE_FIELDS:
        bad = bad.when(P.is_not_text(t[n], a[n]), f"bad_text:{n}")
    bad = bad.when(F.col("la").isNull() & lines.isNotNull() & ~F.is_variant_null(lines), "lines_not_object")
    return rows.select(
        *[c for c in rows.columns if c not in ("m", "edge_starts", "lt", "la")],
        *[t[n].alias(n) for n in EDGE_FIELDS if n != "edge_type"],
        F.coalesce(t["edge_type"], _default_edge_type(F.col("pos"), F.col("edge_starts"))).alias("edge_type"),
        *[P.line_to_int(F.col(f"lt.{n}"), F.col(f"la.{n}")).alias(n) for n in LINE_FIELDS],
        bad.alias("bad"),
    )


def route(decoded: DataFrame, event_type: str) -> DataFrame:
    """The usable events of one type."""
    return decoded.filter((F.col("event_type") == event_type) & F.col("reason").isNull())


def quarantine(decoded: DataFrame) -> DataFrame:
    """Everything set aside, one row each, with the reason and where it stood."""
    key = C.EVENT_KEY
    no_line = F.lit(None).cast("string").alias("line")
    events = decoded.filter(F.col("reason").isNotNull()).select(
        *key, F.lit("event").alias("item"), F.lit(None).cast("int").alias("pos"), "reason", "line"
    )
    mentions = (
        unnest_members(decoded)
        .filter(F.col("bad").isNotNull() | F.col("has_bad_column"))
        .select(
            *key,
            F.when(F.col("bad").isNotNull(), "table").otherwise("columns").alias("item"),
            "pos",
            F.coalesce("bad", F.lit("bad_text:columns")).alias("reason"),
            no_line,
        )
    )
    dots = T.is_dots_only(F.col("from_table")) | T.is_dots_only(F.col("to_table"))
    edges = (
        unnest_edge_members(decoded)
        .withColumn("reason", F.coalesce("bad", F.when(dots, "dots_only_name")))
        .filter(F.col("reason").isNotNull())
        .select(*key, F.lit("edge").alias("item"), "pos", "reason", no_line)
    )
    return events.unionByName(mentions).unionByName(edges)
