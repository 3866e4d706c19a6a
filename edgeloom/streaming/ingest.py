"""Incremental ingest: landed event lines are applied micro-batch by micro-batch, in whatever order they land.

Replays and conflicts over batches are told by Spark's state store: a line goes through if its key and text are new, and a
mark goes with it if its key is. So a batch never reads the events of earlier ones. There is no watermark: late events are
applied, in the order of their sequence numbers. What a batch finds is stored as facts that merge (see `store`). A late
batch can bring the first mention of a table before edges that were stored already: the names for which that is so are
found from the facts, and only the edges at these names are resolved anew. A batch that is repeated overwrites its own
directories; one that has been marked as done is left as it is.

Where two texts under one key land in one batch, the first in text order is the event; over batches it is the one that
landed first. The other is in the quarantine, as `key_conflict`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from edgeloom import constants as C
from edgeloom.functions import keys as K
from edgeloom.operators import ingest_assets as A
from edgeloom.operators import ingest_edges as G
from edgeloom.operators import ingest_files as FI
from edgeloom.operators import ingest_runs as R
from edgeloom.sources import events as EV
from edgeloom.sources import replays as RE
from edgeloom.sources.tables import CODEC, IDS, TABLE_OF, at_once, kept, read_table, write_part
from edgeloom.streaming import store as ST
from edgeloom.streaming.store import prepare

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LINE, FIRST = "line", "first"


def tagged(lines: DataFrame) -> DataFrame:
    """Each line with its key and digest, and for a usable one a second row that stands for its key alone."""
    none = F.lit(0).cast("long")
    both = F.array(
        F.struct(F.lit(LINE).alias("tag"), "d1", "d2", "value"),
        F.struct(F.lit(FIRST).alias("tag"), none.alias("d1"), none.alias("d2"), F.lit(None).cast("string").alias("value")),
    )
    rows = F.when(F.col("run_id") != "", both).otherwise(F.slice(both, 1, 1))
    return RE.line_keys(lines).select(*C.EVENT_KEY, F.inline(rows)).select("tag", *C.EVENT_KEY, *RE.DIGEST, "value")


def unseen(lines: DataFrame) -> DataFrame:
    """The tagged rows that are new: lines by key and text, keys by themselves. On a stream, new since it began."""
    return tagged(lines).dropDuplicates(["tag", *C.EVENT_KEY, *RE.DIGEST])


def _odd(landed: DataFrame) -> DataFrame:
    """Digests of the lines whose key another text has, here or in an earlier batch: d1, d2, taken."""
    usable = landed.filter(F.col("run_id") != "")
    keys = usable.groupBy(*C.EVENT_KEY).agg(F.count_if(F.col("tag") == LINE).alias("n"), F.count_if(F.col("tag") == FIRST).alias("new"))
    odd = keys.filter("n > 1 OR (n > 0 AND new = 0)").select(*C.EVENT_KEY, (F.col("new") == 0).alias("taken"))
    return usable.filter(F.col("tag") == LINE).join(odd, C.EVENT_KEY).select(*RE.DIGEST, "taken")


def _names(df: DataFrame, *ends: str) -> DataFrame:
    """Run and short name of the given columns, each once."""
    each = F.explode(F.array(*ends)).alias("short_name")
    return df.select("run_id", each).distinct()


def _late_names(mine: DataFrame, earlier: dict[str, DataFrame], names: DataFrame) -> DataFrame:
    """Names whose first mention this batch has moved to or before an event applied earlier, with the arrival of it."""
    keys = ["run_id", "short_name"]
    known = A.merge_assets(earlier["assets"].join(names, keys, "left_semi")).select(*keys, F.struct(*A.FIRST_AT).alias("known"))
    last = earlier["run_facts"].join(names.select("run_id").distinct(), "run_id", "left_semi").groupBy("run_id").agg(F.max("last").alias("last"))
    at = F.struct(F.col("first_seq").alias("event_seq"), F.col("first_tie").alias("event_tie"))
    moved = mine.join(last, "run_id").filter(at <= F.col("last")).join(known, keys, "left")
    moved = moved.filter(F.col("known").isNull() | (F.struct(*A.FIRST_AT) < F.col("known")))
    return moved.select(*keys, at.alias("at"))


def _edges_at(edges: DataFrame, late: DataFrame) -> DataFrame:
    """Edges that have a late name at an end and arrived no earlier than its first mention."""

    def end(side: str) -> DataFrame:
        name = late.select(F.col("run_id").alias("late_run"), F.col("short_name").alias("late_name"), F.col("at").alias("late_at"))
        on = (F.col("run_id") == F.col("late_run")) & (F.col(f"{side}_short") == F.col("late_name")) & (F.col("late_at") <= K.arrival())
        return edges.join(name, on, "left_semi")

    return end("from").unionByName(end("to")).dropDuplicates(ST.EDGE_KEY)


def _to_resolve(edges: DataFrame) -> DataFrame:
    """Stored edges in the form of edge mentions, with the skip reason they had."""
    found = ("from_full", "to_full", "lineage_id", "file_id", "from_asset_id", "to_asset_id", "skipped", "run_bucket", "batch_id")
    return edges.drop(*found).withColumnsRenamed({"created_at": "event_time", "skip_reason": "skipped_for"})


def apply_batch(rows: DataFrame, batch_id: int, out: str, short_name_mode: str = "as_given") -> None:
    """Apply the unseen rows of one batch."""
    spark = rows.sparkSession
    if batch_id <= ST.last_done(spark, out):
        return

    def mine(name: str) -> str:
        return f"{out}/{name}/batch_id={batch_id}"

    def write(df: DataFrame, name: str, layout: str = ""):
        layout = layout or name
        ids = IDS.get(TABLE_OF.get(layout, layout), dict)()
        return lambda: write_part(df, mine(name), layout, ids)

    def saved(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", CODEC).parquet(mine(name))
        return read_table(spark, mine(name), name)

    landed = saved(rows, "landed")
    odd = saved(_odd(landed), "odd")
    lines = landed.filter(F.col("tag") == LINE).select("value")
    decoded = saved(EV.decode(RE.settled(lines, odd)), "decoded")

    earlier = ST.facts(spark, out, batch_id - 1)
    mentions = A.asset_mentions(decoded, short_name_mode)
    at_once(
        write(A.first_assets(mentions), "assets"),
        write(A.column_parts(A.column_mentions(mentions)), "asset_columns", "column_facts"),
        write(R.run_facts(decoded), "run_facts"),
        write(R.job_history(decoded), "job_status"),
        write(FI.file_parts(decoded), "files"),
        lambda: EV.quarantine(decoded).write.mode("overwrite").option("compression", CODEC).parquet(mine("quarantine")),
    )
    assets = read_table(spark, mine("assets"), "assets")
    all_facts = earlier["assets"].unionByName(assets, allowMissingColumns=True)

    def resolved(edges: DataFrame) -> DataFrame:
        """The edges against the merged facts of the names they ask for."""
        known = all_facts.join(_names(edges, "from_short", "to_short"), ["run_id", "short_name"], "left_semi")
        found = G.edge_parts(edges, A.merge_assets(known))
        return found.withColumn("skipped", F.col("skip_reason").isNotNull())

    write(resolved(G.edge_mentions(decoded)), "edges", "lineage")()
    late = saved(_late_names(assets, earlier, assets.select("run_id", "short_name")), "late_names")
    fixed_links = None
    if not late.isEmpty():
        affected = _to_resolve(_edges_at(ST.current_edges(earlier), late))
        write(resolved(affected), "edge_fixes", "lineage")()
        fixes = kept(read_table(spark, mine("edge_fixes"), "edges"))
        was_skipped = ST.current_edges(earlier).filter("skipped").select(*ST.EDGE_KEY)
        fixed_links = fixes.join(was_skipped, ST.EDGE_KEY, "left_semi")

    lineage = kept(read_table(spark, mine("edges"), "edges"))
    links = lineage if fixed_links is None else lineage.unionByName(fixed_links.select(*lineage.columns))
    write(A.asset_links(mentions, links, False), "asset_files")()
    ST.mark_done(spark, out, batch_id)


def start_ingest(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    *,
    max_files_per_trigger: int = 1000,
    available_now: bool = True,
    interval: str = "1 minute",
    short_name_mode: str = "as_given",
) -> StreamingQuery:
    """Follow a landing folder. `available_now` applies what has landed and stops."""
    prepare(spark, out)
    fresh = unseen(EV.stream_event_lines(spark, landing, max_files_per_trigger))
    writer = fresh.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, batch_id: apply_batch(df, batch_id, out, short_name_mode)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    spark.conf.set(STATE_STORE, ROCKSDB)  # on disk, so that state may outgrow memory; read when the query starts
    return writer.start()


def read_stream_lake(
    spark: SparkSession, out: str, cancels: DataFrame | None = None, registered: DataFrame | None = None
) -> dict[str, DataFrame]:
    """The tables of the batches done. Assets, columns, edges and runs are merged from their facts as they are read."""
    stored = ST.facts(spark, out)
    tables = stored | {
        "assets": A.merge_assets(stored["assets"]),
        "asset_columns": A.merge_columns(stored["asset_columns"]).drop(*A.FIRST_AT),
        "edges": ST.current_edges(stored),
    }
    tables["lineage"] = kept(tables["edges"])
    run_facts = tables["run_facts"].drop("run_bucket", "batch_id")
    if cancels is not None:
        extra = R.cancel_facts(R.judge_cancels(cancels, tables["decoded"], registered=registered))
        run_facts = run_facts.unionByName(extra, allowMissingColumns=True)
    asked = R.request_jobs(tables["decoded"], cancels, registered=registered)
    tables["job_status"] = tables["job_status"] if asked is None else tables["job_status"].unionByName(asked, allowMissingColumns=True)
    tables["extraction_runs"] = R.runs_from_facts(R.merge_run_facts(run_facts), registered)
    return tables
