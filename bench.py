"""Time the headline queries and print one JSON line.

`ingest` is the raw event log to stored tables, `ingest_stream` the same log landed and streamed, `event_log` the
making of that log; the other queries read the tables and run once each, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import time

from edgeloom.plans.ingest import TABLES
from edgeloom.session import build_session
from edgeloom.workload import QUERIES
from edgeloom.workload import fixtures as X

HEADLINE = [
    "src_1", "src_3", "ing_1", "ing_4", "run_1", "run_3", "run_4", "run_5", "run_6", "run_7", "job_1", "job_2", "job_3",
    "fil_1", "fil_3", "fil_4", "fil_7", "log_1", "log_2", "log_3", "log_7", "ast_6", "ast_7", "ast_12", "ast_13", "ast_14",
    "ast_15", "ast_17", "col_2", "edg_5", "edg_6", "edg_7", "edg_10", "edg_12", "edg_14", "sch_1", "ent_1", "ent_2",
    "ent_3", "lin_1", "lin_2", "lin_3", "lin_4", "lin_5", "lin_6", "snk_2", "str_3", "str_4", "fn_4", "fn_5", "fn_6",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - start, 3)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    timed("event_log", lambda: X.file_log(spark, sf_dir))
    timed("ingest", lambda: X.lake(spark, sf_dir).write(*TABLES))
    timed("run_event_log", lambda: X.run_decoded(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda n=name: drain(QUERIES[n](spark, sf_dir)))
    if os.environ.get("BENCH_STREAM", "1") == "1":
        timed("ingest_stream", lambda: X.streamed_files(spark, sf_dir))
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
