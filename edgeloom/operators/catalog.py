"""The asset catalogue: finders, degrees, first and last sight, listing, detail, search; column finders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom import constants as C
from edgeloom.functions import text as T
from edgeloom.operators.common import Ids, newest, page, pick, top_k, with_totals

# Total orders for results that the data model leaves unordered.
ASSET_ORDER = ["short_name", "created_at", "asset_id"]
RECENCY = ["created_at", "asset_id"]


def assets_of_run(assets: DataFrame, ids: Ids = None) -> DataFrame:
    return pick(assets, "run_id", ids)


def asset_by_full_name(assets: DataFrame, ids: Ids = None, full_name: str | None = None) -> DataFrame:
    """One asset per run and full name: the first seen, where two short names share a full name."""
    picked = pick(assets, "run_id", ids)
    if full_name is not None:
        picked = picked.filter(F.col("full_name") == full_name)
    row = F.min_by(F.struct(*[F.col(c) for c in assets.columns]), F.struct(*RECENCY))
    return picked.groupBy("run_id", "full_name").agg(row.alias("row")).select("row.*")


def asset_by_short_name(assets: DataFrame, keys: DataFrame) -> DataFrame:
    """The asset of each asked (run, short name), case-sensitive; the key is unique."""
    return assets.join(keys.select("run_id", "short_name").distinct(), ["run_id", "short_name"], "left_semi")


def assets_by_name(assets: DataFrame, names: Ids = None) -> DataFrame:
    """Assets of a name over all runs, any case. `name_key` is the name all of them share; the copy by name has it stored."""
    keyed = assets if "name_key" in assets.columns else assets.withColumn("name_key", F.upper("short_name"))
    return pick(keyed, "name_key", upper_names(names))


def upper_names(names: Ids) -> Ids:
    if isinstance(names, DataFrame):
        return names.select(F.upper(names.columns[0]).alias("name_key"))
    if names is None:
        return None
    return [n.upper() for n in ([names] if isinstance(names, str) else names)]


def newest_by_name(assets: DataFrame, names: Ids = None) -> DataFrame:
    """The newest asset of each name, any case, over all runs."""
    return newest(assets_by_name(assets, names), ["name_key"], RECENCY)


def degrees(lineage: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Edges into and out of each asset. Both ends are counted in one pass and one shuffle."""
    ends = lineage.select(
        F.inline(
            F.array(
                F.struct(F.col("to_asset_id").alias("asset_id"), F.lit(1).alias("i"), F.lit(0).alias("o")),
                F.struct(F.col("from_asset_id").alias("asset_id"), F.lit(0).alias("i"), F.lit(1).alias("o")),
            )
        )
    )
    if only is not None:
        ends = ends.join(only, "asset_id", "left_semi")
    return ends.groupBy("asset_id").agg(F.sum("i").alias("upstream_count"), F.sum("o").alias("downstream_count"))


def with_degrees(assets: DataFrame, lineage: DataFrame, only: DataFrame | None = None) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    return assets.join(degrees(lineage, only), "asset_id", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("upstream_count", "downstream_count")}
    )


def seen(links: DataFrame) -> DataFrame:
    """First and last sight of each asset, from its links to files."""
    return links.groupBy("asset_id").agg(
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at")
    )


def links_of(links: DataFrame, runs: Ids = None, assets: Ids = None) -> DataFrame:
    return pick(pick(links, "run_id", runs), "asset_id", assets)


def _named_like(assets: DataFrame, q: str | None) -> DataFrame:
    """Assets whose short or full name contains `q`, any case; a white-space `q` filters nothing."""
    if q is None or not q.strip():
        return assets
    needle = F.lit(q)
    return assets.filter(
        T.contains_any_case(F.col("short_name"), needle) | T.contains_any_case(F.col("full_name"), needle)
    )


def list_assets(
    assets: DataFrame, lineage: DataFrame, links: DataFrame, q: str | None = None, page_no: int = 0, size: int = 20
) -> DataFrame:
    """A page of assets with degrees and sight. The page is cut first; edges and links are then reduced to the
    page's assets by a semi join before they are counted."""
    matching = _named_like(assets, q)
    rows = page(matching, [F.asc(c) for c in ASSET_ORDER], page_no, size)
    ids = rows.select("asset_id")
    shown = rows.select("asset_id", "short_name", "full_name", "schema_name", "role", "created_at")
    items = with_degrees(shown, lineage, only=ids).join(
        seen(links.join(ids, "asset_id", "left_semi")), "asset_id", "left"
    )
    return with_totals(items, matching, page_no, size).orderBy(*ASSET_ORDER)


def asset_columns(columns: DataFrame, assets: Ids = None, role: str | None = None) -> DataFrame:
    picked = pick(columns, "asset_id", assets)
    return picked if role is None else picked.filter(F.col("role") == role)


def columns_without(columns: DataFrame, assets: DataFrame) -> DataFrame:
    """The snapshot that remains when the columns of `assets` (an id column) are deleted."""
    return columns.join(assets.select("asset_id"), "asset_id", "left_anti")


def search(assets: DataFrame, queries: Sequence[str], limit: int = C.SEARCH_LIMIT) -> DataFrame:
    """For each search text, the first assets whose short or full name contains it, any case.

    Texts are trimmed and lowered; blank ones find nothing. They are request parameters, so they enter the one
    scan of the catalogue as literals and no join is needed.
    """
    asked = F.array(*[F.lit(q) for q in dict.fromkeys(queries)]) if queries else F.array().cast("array<string>")
    names = [F.lower(F.coalesce(c, F.lit(""))) for c in ("short_name", "full_name")]
    hits = F.filter(
        asked,
        lambda q: (T.trim_lower(q) != "")
        & (F.contains(names[0], T.trim_lower(q)) | F.contains(names[1], T.trim_lower(q))),
    )
    found = assets.select("asset_id", "short_name", "full_name", "created_at", F.explode(hits).alias("query"))
    return top_k(found, ["query"], [F.asc(c) for c in ASSET_ORDER], limit, salt="asset_id").select(
        "query",
        F.col("short_name").alias("entity_id"),
        F.col("full_name").alias("entity_name"),
        F.lit(C.ENTITY_TYPE).alias("entity_type"),
        F.lit(None).cast("int").alias("column_count"),
        "rn",
    )
