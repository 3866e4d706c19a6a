"""Small hand-written logs."""

from __future__ import annotations

import io
import json
from contextlib import redirect_stdout


def event(kind, run, seq, data, time="2024-01-01T10:00:00", **more):
    return json.dumps({"eventType": kind, "runId": run, "event_seq": seq, "timestamp": time, "data": data, **more})


def file_event(run, seq, **data):
    return event("file_extraction", run, seq, {"filePath": f"f{seq}.sql", "status": "success", **data})


def table(name, role="source", **more):
    return {"name": name, "role": role, **more}


def edge(a, b, **more):
    return {"from_table": a, "to_table": b, **more}


def lines(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def decoded(spark, *texts):
    from edgeloom.sources.replays import decode_lines

    return decode_lines(lines(spark, *texts))


def ingested(spark, *texts):
    """Assets, columns, resolved edges and links of a log, without storing anything."""
    from edgeloom.operators import ingest_assets as A
    from edgeloom.operators import ingest_edges as G

    d = decoded(spark, *texts)
    mentions = A.asset_mentions(d)
    assets = A.first_assets(mentions)
    resolved = G.resolve_edges(G.edge_mentions(d), assets)
    return {
        "decoded": d,
        "assets": assets,
        "columns": A.first_columns(A.column_mentions(mentions)),
        "resolved": resolved,
        "lineage": G.kept_edges(resolved),
        "links": A.asset_links(mentions, G.kept_edges(resolved)),
    }


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def plan(df) -> str:
    text = io.StringIO()
    with redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()
