"""One-hop lineage by name over all runs, in one or both directions, for the asked centres or for all.

Each edge is seen from both of its ends: as an upstream answer for its target and as a downstream answer for its
source. Groups are reduced by aggregates that combine before the shuffle; centres are joined to the reduced rows.
The answer to a question is a set of flat rows; nesting is a last step at a grain of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import text as T
from edgeloom.operators.catalog import newest_by_name, upper_names
from edgeloom.operators.common import Ids, pick

# Order in which edges count as "first". The run id splits ties of logs numbered per run.
EDGE_ORDER = ["event_seq", "event_tie", "run_id", "pos"]


def edge_order() -> Column:
    return F.struct(*EDGE_ORDER)


def edges_of_run(lineage: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(lineage, "run_id", ids)


def edges_into(lineage: DataFrame, assets: Ids = None) -> DataFrame:
    return pick(lineage, "to_asset_id", assets)


def edges_out_of(lineage: DataFrame, assets: Ids = None) -> DataFrame:
    return pick(lineage, "from_asset_id", assets)


def edges_into_name(lineage: DataFrame, names: Ids = None) -> DataFrame:
    return _at_name(lineage, C.UPSTREAM, "to_short", names)


def edges_out_of_name(lineage: DataFrame, names: Ids = None) -> DataFrame:
    return _at_name(lineage, C.DOWNSTREAM, "from_short", names)


def _at_name(lineage: DataFrame, direction: str, end: str, names: Ids) -> DataFrame:
    if "name_key" in lineage.columns:
        rows = lineage.filter(F.col("direction") == direction).drop("direction", "neighbor", "neighbor_full")
    else:
        rows = lineage.withColumn("name_key", F.upper(end))
    return pick(rows, "name_key", upper_names(names))


def _lines() -> Column:
    """Line range; a range with one end keeps it, one with none is null."""
    some = F.col("start_line").isNotNull() | F.col("end_line").isNotNull()
    return F.when(some, F.struct("start_line", "end_line"))


def edge_details(lineage: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(lineage, "lineage_id", ids).select(
        F.col("lineage_id").alias("edge_id"),
        "edge_type",
        F.col("from_short").alias("from_entity"),
        F.col("to_short").alias("to_entity"),
        "from_column",
        "to_column",
        "transformation_type",
        F.col("file_path").alias("file_id"),
        _lines().alias("lines"),
    )


def centres(assets: DataFrame, names: Ids = None) -> DataFrame:
    """The entity of each name: its newest asset. `name_key` is the name in upper case."""
    return newest_by_name(assets, names).select(
        "name_key", F.col("short_name").alias("entity_id"), F.col("full_name").alias("entity_name")
    )


def unknown_names(assets: DataFrame, names: DataFrame) -> DataFrame:
    """Asked names without an entity."""
    column = names.columns[0]
    known = assets.select(F.upper("short_name").alias("name_key"))
    return (
        names.withColumn("name_key", F.upper(column)).join(known, "name_key", "left_anti").select(column).distinct()
    )


def seen_from(lineage: DataFrame, direction: str | None = None, names: Ids = None) -> DataFrame:
    """Edges from the side of their centre: `direction`, `name_key`, and the neighbour's names. The copy by name is stored
    in this form, so asked names and a direction read only the directories and row groups that hold them."""
    if "name_key" in lineage.columns:
        rows = lineage if direction is None else lineage.filter(F.col("direction") == direction)
        return pick(rows, "name_key", upper_names(names))

    def side(label: str, centre: str, neighbour: str) -> Column:
        return F.struct(
            F.lit(label).alias("direction"),
            F.upper(f"{centre}_short").alias("name_key"),
            F.col(f"{neighbour}_short").alias("neighbor"),
            F.col(f"{neighbour}_full").alias("neighbor_full"),
        )

    sides = {C.UPSTREAM: side(C.UPSTREAM, "to", "from"), C.DOWNSTREAM: side(C.DOWNSTREAM, "from", "to")}
    wanted = list(sides.values()) if direction is None else [sides[direction]]
    return pick(lineage.select("*", F.inline(F.array(*wanted))), "name_key", upper_names(names))


def with_centres(rows: DataFrame, assets: DataFrame, names: Ids) -> DataFrame:
    return rows.join(centres(assets, names), "name_key")


def neighbours(assets: DataFrame, lineage: DataFrame, direction: str | None = None, names: Ids = None) -> DataFrame:
    """Neighbours of each centre by exact name. The full name comes from the first edge."""
    rows = (
        seen_from(lineage, direction, names)
        .groupBy("direction", "name_key", "neighbor")
        .agg(F.min_by("neighbor_full", edge_order()).alias("neighbor_full"), F.count(F.lit(1)).alias("n_edges"))
    )
    return with_centres(rows, assets, names).select(
        "direction", "entity_id", "entity_name", "neighbor", "neighbor_full", "n_edges"
    )


def distinct_transformations(lineage: DataFrame, direction: str | None, names: Ids) -> DataFrame:
    """Transformations per neighbour: same file, lines and type count once; null and empty are the same. The
    first edge lends its values."""
    columns = ["file_path", "start_line", "end_line", "transformation_type"]
    keyed = seen_from(lineage, direction, names).select(
        "direction",
        "name_key",
        "neighbor",
        *[T.dedupe_part(F.col(c)).alias(f"k{i}") for i, c in enumerate(columns)],
        F.struct(edge_order().alias("at"), "neighbor_full", *columns).alias("edge"),
    )
    return (
        keyed.groupBy("direction", "name_key", "neighbor", *[f"k{i}" for i in range(len(columns))])
        .agg(F.min("edge").alias("edge"))
        .select("direction", "name_key", "neighbor", "edge.*")
    )


def transformations(
    assets: DataFrame, lineage: DataFrame, direction: str | None = None, names: Ids = None
) -> DataFrame:
    rows = distinct_transformations(lineage, direction, names)
    return with_centres(rows, assets, names).select(
        "direction",
        "entity_id",
        "neighbor",
        F.col("file_path").alias("file_id"),
        "transformation_type",
        "start_line",
        "end_line",
    )


def is_column_pair() -> Column:
    """A column edge that names at least one column."""
    blank = T.is_white(F.col("from_column")) & T.is_white(F.col("to_column"))
    return (F.lower("edge_type") == C.COLUMN_EDGE) & ~blank


def column_pairs(lineage: DataFrame, direction: str | None, names: Ids) -> DataFrame:
    """Column pairs of each centre, the first edge kept. The pair key spells a missing column `null`."""
    keyed = seen_from(lineage.filter(is_column_pair()), direction, names).select(
        "direction",
        "name_key",
        "neighbor",
        F.coalesce("from_column", F.lit("null")).alias("from_key"),
        F.coalesce("to_column", F.lit("null")).alias("to_key"),
        F.struct(
            edge_order().alias("at"),
            "from_column",
            "to_column",
            F.col("file_path").alias("file_id"),
            "transformation_type",
            "start_line",
            "end_line",
        ).alias("edge"),
    )
    return (
        keyed.groupBy("direction", "name_key", "neighbor", "from_key", "to_key")
        .agg(F.min("edge").alias("edge"))
        .select("direction", "name_key", "neighbor", "edge.*")
    )


def column_lineage(
    assets: DataFrame, lineage: DataFrame, direction: str | None = None, names: Ids = None
) -> DataFrame:
    """Column pairs: the upstream field with the transformation, and the downstream field."""
    rows = with_centres(column_pairs(lineage, direction, names), assets, names)
    up = F.col("direction") == C.UPSTREAM
    return rows.select(
        "direction",
        "entity_id",
        F.when(up, F.col("neighbor")).otherwise(F.col("entity_id")).alias("from_entity"),
        "from_column",
        F.when(up, F.col("entity_id")).otherwise(F.col("neighbor")).alias("to_entity"),
        "to_column",
        "file_id",
        "transformation_type",
        "start_line",
        "end_line",
    )


def names_of_assets(assets: DataFrame, ids: Ids = None) -> DataFrame:
    """Asset ids with their name."""
    return pick(assets, "asset_id", ids).select("asset_id", F.upper("short_name").alias("name_key"))


def entities_of_assets(assets: DataFrame, ids: Ids = None) -> DataFrame:
    """Asset ids with the entity they stand for: the newest asset of their name."""
    asked = names_of_assets(assets, ids)
    return asked.join(centres(assets, None if ids is None else asked.select("name_key").distinct()), "name_key").drop("name_key")


def answers_of_assets(
    assets: DataFrame, lineage: DataFrame, direction: str | None = None, ids: Ids = None
) -> dict[str, DataFrame]:
    """The whole lineage answer by asset id, each part once per name: `ids` says which entity an id stands for, and
    `neighbours`, `transformations` and `pairs` have the rows of each entity. So assets that share a name share rows."""
    names = None if ids is None else names_of_assets(assets, ids).select("name_key").distinct()
    return {
        "ids": entities_of_assets(assets, ids),
        "neighbours": neighbours(assets, lineage, direction, names),
        "transformations": transformations(assets, lineage, direction, names),
        "pairs": column_lineage(assets, lineage, direction, names),
    }


def lineage_of_assets(
    assets: DataFrame, lineage: DataFrame, direction: str | None = None, ids: Ids = None
) -> DataFrame:
    """Neighbours by asset id: the id stands for its name, so assets sharing a name get the same answer. The
    answer is made once per name; its rows are repeated per asset as they are asked."""
    asked = names_of_assets(assets, ids)
    rows = neighbours(assets, lineage, direction, None if ids is None else asked.select("name_key").distinct())
    return asked.join(rows.withColumn("name_key", F.upper("entity_id")), "name_key").drop("name_key")
