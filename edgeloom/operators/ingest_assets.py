"""Table mentions of file events to assets, their columns, and links to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.functions import text as T
from edgeloom.sources.events import unnest_members


def unnest_tables(decoded: DataFrame) -> DataFrame:
    """One row per usable table mention; blank names are skipped."""
    members = unnest_members(decoded, "event_time")
    return members.filter(F.col("bad").isNull() & ~T.is_blank(F.col("name"))).drop("bad", "has_bad_column")


def with_role(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("role", T.asset_role(F.col("role")))


def with_schema(mentions: DataFrame) -> DataFrame:
    """The stated schema, else the dotted prefix of the name, else the default."""
    given = F.col("schema")
    return mentions.withColumn(
        "schema_name", F.when(T.is_blank(given), T.schema_of_name(F.col("name"))).otherwise(given)
    ).drop("schema")


def with_full_name(mentions: DataFrame) -> DataFrame:
    return mentions.withColumn("full_name", T.full_name(F.col("schema_name"), F.col("name")))


def without_intermediates(mentions: DataFrame) -> DataFrame:
    return mentions.filter(F.col("role") != C.INTERMEDIATE)


def asset_mentions(decoded: DataFrame, short_name_mode: str = "as_given") -> DataFrame:
    """Mentions that make assets. The short name is the name as given, dots included; edges look for the last
    part only, so `short_name_mode='last_part'` is there for those who want the two to meet."""
    mentions = without_intermediates(with_full_name(with_schema(with_role(unnest_tables(decoded)))))
    short = F.col("name") if short_name_mode == "as_given" else T.short_name(F.col("name"))
    return mentions.select(
        *C.EVENT_KEY, "pos", "event_time", short.alias("short_name"), "role", "schema_name", "full_name", "columns"
    )


ASSET_COLUMNS = [
    "asset_id", "run_id", "full_name", "short_name", "schema_name", "role", "created_at",
    "first_seq", "first_tie", "first_pos",
]


def merge_assets(*parts: DataFrame) -> DataFrame:
    """One asset per run and short name. The first mention decides; later ones fill what is still null."""
    rows = parts[0].select(*ASSET_COLUMNS)
    for p in parts[1:]:
        rows = rows.unionByName(p.select(*ASSET_COLUMNS))
    at = F.struct("first_seq", "first_tie", "first_pos")

    def first_known(name: str) -> Column:
        return F.min_by(name, F.when(F.col(name).isNotNull(), at)).alias(name)

    merged = rows.groupBy("run_id", "short_name").agg(
        F.min(at).alias("at"),
        F.min_by("created_at", at).alias("created_at"),
        *[first_known(c) for c in ("full_name", "schema_name", "role")],
    )
    return merged.select("*", "at.*", K.asset_id("run_id", "short_name").alias("asset_id")).select(*ASSET_COLUMNS)


def first_assets(mentions: DataFrame) -> DataFrame:
    """Assets of one batch: the first mention per run and short name. One aggregate over one value, combined
    before the shuffle, so a table named in every file costs one row per task."""
    first = F.min(
        F.struct(*C.ARRIVAL, "pos", "event_time", "role", "schema_name", "full_name")
    )
    return (
        mentions.groupBy("run_id", "short_name")
        .agg(first.alias("f"))
        .select(
            K.asset_id("run_id", "short_name").alias("asset_id"),
            "run_id",
            "f.full_name",
            "short_name",
            "f.schema_name",
            "f.role",
            F.col("f.event_time").alias("created_at"),
            F.col("f.event_seq").alias("first_seq"),
            F.col("f.event_tie").alias("first_tie"),
            F.col("f.pos").alias("first_pos"),
        )
    )


def column_mentions(mentions: DataFrame) -> DataFrame:
    """One row per named column; white-space names are dropped, the rest trimmed and lowered."""
    return (
        mentions.select(
            *C.EVENT_KEY, "pos", "event_time", "short_name", "role", F.posexplode("columns").alias("column_pos", "raw")
        )
        .filter(~T.is_white(F.col("raw")))
        .withColumn("column_name", T.trim_lower(F.col("raw")))
        .drop("raw")
    )


def asset_ids() -> dict[str, Column]:
    return {"asset_id": K.asset_id("run_id", "short_name")}


COLUMN_KEY = ["run_id", "short_name", "role", "column_name"]


def first_column_mentions(named: DataFrame) -> DataFrame:
    """Column rows of the earliest mention of each key, with its place. A name twice in its first list is there twice: the
    list is compared with what came before it. The rank is limited before the shuffle, so repeats stay local."""
    return column_parts(named).select(*[e.alias(c) for c, e in column_ids().items()], *COLUMN_FACTS)


FIRST_AT = ["first_seq", "first_tie", "first_pos"]
COLUMN_FACTS = ["run_id", "short_name", "column_name", "role", "created_at", *FIRST_AT]


def column_parts(named: DataFrame) -> DataFrame:
    """The same rows without their ids, with what `column_ids` needs."""
    w = Window.partitionBy(*COLUMN_KEY).orderBy(*C.ARRIVAL, "pos")
    first = named.withColumn("mention", F.rank().over(w)).filter("mention = 1")
    return first.select(
        "run_id",
        "short_name",
        "column_name",
        "role",
        F.col("event_time").alias("created_at"),
        F.col("event_seq").alias("first_seq"),
        F.col("event_tie").alias("first_tie"),
        F.col("pos").alias("first_pos"),
        "column_pos",
    )


def column_ids() -> dict[str, Column]:
    return {
        "asset_column_id": K.stable_id(*COLUMN_KEY, *FIRST_AT, "column_pos"),
        "asset_id": K.asset_id("run_id", "short_name"),
    }


def merge_columns(facts: DataFrame) -> DataFrame:
    """The earliest mention over facts that were found apart, each the earliest of its part."""
    w = Window.partitionBy(*COLUMN_KEY).orderBy(*FIRST_AT)
    return facts.withColumn("mention", F.rank().over(w)).filter("mention = 1").drop("mention")


def first_columns(named: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Columns not known before their mention, and not among those `stored` before."""
    first = first_column_mentions(named).drop(*FIRST_AT)
    if stored is not None:
        first = first.join(stored.select(*COLUMN_KEY).distinct(), COLUMN_KEY, "left_anti")
    return first


def asset_links(mentions: DataFrame, lineage: DataFrame, with_ids: bool = True) -> DataFrame:
    """Asset to file: one row per kept mention and two per kept edge. Duplicates stay. Without ids, they are `link_parts`."""
    if not with_ids:
        return link_parts(mentions, lineage)
    ids = link_ids()
    return link_parts(mentions, lineage).select(
        ids["asset_file_id"].alias("asset_file_id"),
        "run_id",
        ids["file_id"].alias("file_id"),
        ids["asset_id"].alias("asset_id"),
        "side",
        "created_at",
    )


def link_ids() -> dict[str, Column]:
    return {
        "asset_file_id": K.stable_id(*C.EVENT_KEY, "side", "pos"),
        "file_id": K.stable_id(*C.EVENT_KEY),
        "asset_id": K.asset_id("run_id", "short_name"),
    }


def link_parts(mentions: DataFrame, lineage: DataFrame) -> DataFrame:
    """The same rows without their ids, with what `link_ids` needs."""

    def link(side: str, short: str, at: str) -> list:
        return [
            F.lit(side).alias("side"),
            F.col(short).alias("short_name"),
            F.col(at).alias("created_at"),
        ]

    of_tables = mentions.select(*C.EVENT_KEY, "pos", *link("table", "short_name", "event_time"))
    of_edges = lineage.select(
        *C.EVENT_KEY,
        "pos",
        F.inline(
            F.array(F.struct(*link("from", "from_short", "created_at")), F.struct(*link("to", "to_short", "created_at")))
        ),
    )
    return of_tables.unionByName(of_edges)
