"""Edges of file events: clean, resolve both ends to stored assets, report what is skipped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import text as T
from edgeloom.sources.events import unnest_edge_members


def unnest_edges(decoded: DataFrame) -> DataFrame:
    """The usable members of all five edge arrays, typed by their array where they state no type."""
    members = unnest_edge_members(decoded, "event_time", F.col("file.filePath").alias("file_path"))
    return members.filter(F.col("bad").isNull()).drop("bad")


def with_both_ends(edges: DataFrame) -> DataFrame:
    """Skip blank ends. Ends made of dots name nothing; they are in the quarantine."""
    ends = (F.col("from_table"), F.col("to_table"))
    keep = F.lit(True)
    for end in ends:
        keep = keep & ~T.is_blank(end) & ~T.is_dots_only(end)
    return edges.filter(keep)


def with_edge_type(edges: DataFrame) -> DataFrame:
    return edges.withColumn("edge_type", T.edge_type(F.col("edge_type")))


def with_transformation(edges: DataFrame) -> DataFrame:
    given = F.col("transformation_type")
    return edges.withColumn(
        "transformation_type", F.when(T.is_blank(given), C.UNKNOWN_TRANSFORMATION).otherwise(given)
    )


def edge_mentions(decoded: DataFrame) -> DataFrame:
    edges = with_transformation(with_edge_type(with_both_ends(unnest_edges(decoded))))
    return edges.withColumn("from_short", T.short_name(F.col("from_table"))).withColumn(
        "to_short", T.short_name(F.col("to_table"))
    )


LINEAGE_COLUMNS = [
    "lineage_id", "run_id", "event_seq", "event_tie", "pos", "file_id", "file_path", "from_asset_id", "to_asset_id",
    "from_short", "from_full", "to_short", "to_full", "from_column", "to_column", "edge_type", "transformation_type",
    "start_line", "end_line", "created_at",
]


def resolve_edges(edges: DataFrame, assets: DataFrame, how: str = "left") -> DataFrame:
    """Look up both ends among the assets of the run that were known when the edge arrived.

    An end is known if its asset was first mentioned no later than the edge. Each lookup meets a unique key, so
    rows never multiply; a hot table is a hot partition of the edge side, which adaptive execution splits.
    With `how='left'` the unresolved edges stay, with a `skip_reason`.
    """
    ids = edge_ids()
    return edge_parts(edges, assets, how).select(*[ids[c].alias(c) if c in ids else c for c in [*LINEAGE_COLUMNS, "skip_reason"]])


def edge_ids() -> dict[str, Column]:
    return {
        "lineage_id": K.stable_id(*C.EVENT_KEY, "pos"),
        "file_id": K.stable_id(*C.EVENT_KEY),
        "from_asset_id": K.asset_id("run_id", "from_short"),
        "to_asset_id": K.asset_id("run_id", "to_short"),
    }


def edge_parts(edges: DataFrame, assets: DataFrame, how: str = "left") -> DataFrame:
    """The rows of `resolve_edges` without their ids."""
    known = assets.select(
        "run_id", "short_name", "full_name", F.struct("first_seq", "first_tie").alias("first_at")
    )

    def end(df: DataFrame, side: str) -> DataFrame:
        a = known.select(
            F.col("run_id").alias("a_run"),
            F.col("short_name").alias("a_short"),
            F.col("full_name").alias(f"{side}_full"),
            F.col("first_at").alias("a_first"),
        )
        on = (
            (F.col("run_id") == F.col("a_run"))
            & (F.col(f"{side}_short") == F.col("a_short"))
            & (F.col("a_first") <= F.struct("event_seq", "event_tie"))
        )
        return df.join(a, on, how).drop("a_run", "a_short", "a_first")

    both = end(end(edges, "from"), "to")
    return both.select(
        *C.EVENT_KEY,
        "pos",
        "file_path",
        "from_short",
        "from_full",
        "to_short",
        "to_full",
        "from_column",
        "to_column",
        "edge_type",
        "transformation_type",
        "start_line",
        "end_line",
        F.col("event_time").alias("created_at"),
        F.when(F.col("from_full").isNull() & F.col("to_full").isNull(), "both_ends_unknown")
        .when(F.col("from_full").isNull(), "from_unknown")
        .when(F.col("to_full").isNull(), "to_unknown")
        .alias("skip_reason"),
    )


def kept_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("skip_reason").isNull()).select(*LINEAGE_COLUMNS)


def skipped_edges(resolved: DataFrame) -> DataFrame:
    return resolved.filter(F.col("skip_reason").isNotNull()).select(
        *C.EVENT_KEY, "pos", "file_path", "from_short", "to_short", "skip_reason"
    )


def repair_edges(resolved: DataFrame, assets: DataFrame) -> DataFrame:
    """Resolve the skipped edges once more, now against every asset of the run whatever its arrival. Off by
    default: arrival order keeps such edges out."""
    skipped = (
        resolved.filter(F.col("skip_reason").isNotNull())
        .withColumnRenamed("created_at", "event_time")
        .drop("from_full", "to_full", "skip_reason", "lineage_id", "file_id", "from_asset_id", "to_asset_id")
    )
    everything = assets.withColumn("first_seq", F.lit(-(2**63)).cast("bigint"))
    return kept_edges(resolve_edges(skipped, everything, "inner"))
