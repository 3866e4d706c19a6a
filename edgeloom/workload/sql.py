"""SQL of the same facts straight from the driver tables, without JSON, for the comparison with DuckDB."""

from __future__ import annotations


def sid(*parts: str) -> str:
    return "sha256(concat_ws(chr(1), " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + "))"


def _mentions(spelling: str) -> str:
    return f"""
SELECT concat('run-', CAST(l_suppkey AS VARCHAR)) AS run_id, l_orderkey AS event_seq,
  CAST(row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS INTEGER) - 1
    AS pos,
  CAST('2020-01-01' AS DATE) + CAST(floor(l_orderkey / 100) AS INTEGER) AS event_date,
  concat('models/order_', CAST(l_orderkey AS VARCHAR), '.sql') AS file_path,
  CASE WHEN l_linenumber % 5 = 0 THEN {spelling}(concat('tbl_', CAST(l_partkey % 40 AS VARCHAR)))
    ELSE concat('tbl_', CAST(l_partkey % 40 AS VARCHAR)) END AS name,
  CASE l_returnflag WHEN 'A' THEN 'SOURCE' WHEN 'R' THEN 'target' ELSE 'other' END AS stated_role,
  CASE l_returnflag WHEN 'A' THEN 'SOURCE' WHEN 'R' THEN 'TARGET' ELSE 'INTERMEDIATE' END AS role,
  CASE l_linestatus WHEN 'F' THEN 'unknown_schema' ELSE concat('sch_', CAST(l_linenumber AS VARCHAR)) END AS schema_name,
  l_linenumber AS n,
  concat('tbl_', CAST(l_partkey % 40 AS VARCHAR)) AS from_short,
  concat('tbl_', CAST(l_orderkey % 40 AS VARCHAR)) AS to_short,
  concat('c', CAST(l_linenumber AS VARCHAR)) AS to_column,
  CASE l_linestatus WHEN 'F' THEN 'column_edge' ELSE 'table_edge' END AS edge_type,
  CASE l_linenumber % 3 WHEN 0 THEN 'JOIN' WHEN 1 THEN 'AGG' END AS stated_transformation,
  l_linenumber AS start_line, l_linenumber + 5 AS end_line,
  CASE WHEN l_linenumber % 2 = 1 THEN 0 WHEN l_linestatus = 'F' AND l_linenumber % 4 = 0 THEN 2
    WHEN l_linestatus = 'F' THEN 4 WHEN l_linenumber % 4 = 0 THEN 3 ELSE 1 END AS array_no
FROM lineitem"""


VIEWS = {
    # Table mentions and edges: one per lineitem row.
    "m0": _mentions("upper"),
    "m": """
SELECT *, CAST(row_number() OVER (PARTITION BY run_id, event_seq ORDER BY array_no, pos) AS INTEGER) - 1 AS edge_pos,
  CAST(event_date AS TIMESTAMP) AS event_time
FROM m0""",
    # Assets: the first mention decides.
    "a": f"""
SELECT {sid("run_id", "name")} AS asset_id, run_id, name AS short_name, role, schema_name,
  concat(schema_name, '.', name) AS full_name, event_time AS created_at, event_seq AS first_seq
FROM m WHERE role <> 'INTERMEDIATE'
QUALIFY row_number() OVER (PARTITION BY run_id, name ORDER BY event_seq, pos) = 1""",
    "cm": """
SELECT run_id, event_seq, pos, event_time, name, role, column_pos,
  CASE column_pos WHEN 0 THEN 'qty' ELSE to_column END AS column_name
FROM m, (VALUES (0), (1), (2)) AS v(column_pos) WHERE role <> 'INTERMEDIATE'""",
    "col": f"""
SELECT {sid("run_id", "name", "role", "column_name", "event_seq", "0", "pos", "column_pos")} AS asset_column_id,
  {sid("run_id", "name")} AS asset_id, run_id, name AS short_name, column_name, role, event_time AS created_at
FROM cm QUALIFY rank() OVER (PARTITION BY run_id, name, role, column_name ORDER BY event_seq, pos) = 1""",
    # Edges with both ends looked up among assets known by then; e is the kept part.
    "x": f"""
SELECT {sid("m.run_id", "m.event_seq", "0", "m.edge_pos")} AS lineage_id, m.run_id, m.event_seq, m.edge_pos AS pos,
  {sid("m.run_id", "m.event_seq", "0")} AS file_id, m.file_path,
  {sid("m.run_id", "m.from_short")} AS from_asset_id, {sid("m.run_id", "m.to_short")} AS to_asset_id,
  m.from_short, a.full_name AS from_full, m.to_short, b.full_name AS to_full,
  'qty' AS from_column, m.to_column, m.edge_type, coalesce(m.stated_transformation, 'UNKNOWN') AS transformation_type,
  m.start_line, m.end_line, m.event_time AS created_at,
  CASE WHEN a.full_name IS NULL AND b.full_name IS NULL THEN 'both_ends_unknown'
    WHEN a.full_name IS NULL THEN 'from_unknown' WHEN b.full_name IS NULL THEN 'to_unknown' END AS skip_reason
FROM m
LEFT JOIN a ON a.run_id = m.run_id AND a.short_name = m.from_short AND a.first_seq <= m.event_seq
LEFT JOIN a AS b ON b.run_id = m.run_id AND b.short_name = m.to_short AND b.first_seq <= m.event_seq""",
    "e": "SELECT * EXCLUDE (skip_reason) FROM x WHERE skip_reason IS NULL",
    "links": f"""
SELECT {sid("run_id", "event_seq", "0", "'table'", "pos")} AS asset_file_id, run_id,
  {sid("run_id", "event_seq", "0")} AS file_id, {sid("run_id", "name")} AS asset_id, 'table' AS side,
  event_time AS created_at
FROM m WHERE role <> 'INTERMEDIATE'
UNION ALL SELECT {sid("run_id", "event_seq", "0", "'from'", "pos")}, run_id, file_id, from_asset_id, 'from', created_at FROM e
UNION ALL SELECT {sid("run_id", "event_seq", "0", "'to'", "pos")}, run_id, file_id, to_asset_id, 'to', created_at FROM e""",
    # The newest asset of each name.
    "c": """
SELECT upper(short_name) AS name_key, * FROM a
QUALIFY row_number() OVER (PARTITION BY upper(short_name) ORDER BY created_at DESC, asset_id DESC) = 1""",
    # Edges seen from their centre, and the three reductions of them.
    "s": """
SELECT 'upstream' AS direction, upper(to_short) AS name_key, from_short AS neighbor, from_full AS neighbor_full, * FROM e
UNION ALL
SELECT 'downstream', upper(from_short), to_short, to_full, * FROM e""",
    "nb": """
SELECT s.direction, c.short_name AS entity_id, c.full_name AS entity_name, s.neighbor, s.neighbor_full,
  count(*) OVER (PARTITION BY s.direction, s.name_key, s.neighbor) AS n_edges
FROM s JOIN c ON c.name_key = s.name_key
QUALIFY row_number() OVER (PARTITION BY s.direction, s.name_key, s.neighbor ORDER BY event_seq, s.run_id, pos) = 1""",
    "tr": """
SELECT s.direction, c.short_name AS entity_id, s.neighbor, s.file_path AS file_id, s.transformation_type,
  s.start_line, s.end_line
FROM s JOIN c ON c.name_key = s.name_key
GROUP BY ALL""",
    "cp": """
SELECT s.direction, c.short_name AS entity_id,
  CASE s.direction WHEN 'upstream' THEN s.neighbor ELSE c.short_name END AS from_entity, s.from_column,
  CASE s.direction WHEN 'upstream' THEN c.short_name ELSE s.neighbor END AS to_entity, s.to_column,
  s.file_path AS file_id, s.transformation_type, s.start_line, s.end_line
FROM s JOIN c ON c.name_key = s.name_key
WHERE s.edge_type = 'column_edge'
QUALIFY row_number() OVER (PARTITION BY s.direction, s.name_key, s.neighbor, from_column, to_column
  ORDER BY event_seq, s.run_id, pos) = 1""",
    "ent": """
SELECT c.name_key, c.asset_id, c.short_name AS entity_id, c.full_name AS entity_name, 'table' AS entity_type,
  c.schema_name AS source,
  (SELECT count(*) FROM col WHERE col.asset_id = c.asset_id AND col.role = 'TARGET') AS column_count,
  (SELECT count(*) FROM e WHERE e.to_asset_id = c.asset_id) AS upstream_count,
  (SELECT count(*) FROM e WHERE e.from_asset_id = c.asset_id) AS downstream_count
FROM c""",
    "pairs": """
SELECT c.short_name AS entity_id, CASE o.side WHEN 0 THEN 'upstream' ELSE 'downstream' END AS direction,
  o.from_short AS from_entity, o.from_column, o.to_short AS to_entity, o.to_column, o.file_path AS file_id,
  o.transformation_type, o.start_line, o.end_line
FROM c JOIN (SELECT 0 AS side, to_asset_id AS asset_id, * FROM e UNION ALL SELECT 1, from_asset_id, * FROM e) AS o
  ON o.asset_id = c.asset_id
WHERE o.edge_type = 'column_edge'
QUALIFY row_number() OVER (PARTITION BY c.asset_id, o.from_short, o.from_column, o.to_short, o.to_column
  ORDER BY o.side, o.event_seq, o.run_id, o.pos) = 1""",
    "deg": """
SELECT asset_id, sum(i)::BIGINT AS upstream_count, sum(o)::BIGINT AS downstream_count
FROM (SELECT to_asset_id AS asset_id, 1 AS i, 0 AS o FROM e UNION ALL SELECT from_asset_id, 0, 1 FROM e) GROUP BY ALL""",
    # Run events: what each row of events stands for, and the usable events.
    "rk": """
SELECT event_id AS event_seq, concat('run-', CAST(user_id AS VARCHAR)) AS run_id,
  concat('pod-', CAST(event_id % 7 AS VARCHAR)) AS pod_id, ts, value, props, event_type AS view_type, user_id,
  CASE WHEN event_id % 17 = 0 THEN 'cancel' WHEN event_id % 13 = 0 THEN 'heartbeat'
    WHEN event_type = 'view' THEN 'progress_update' WHEN event_type = 'click' THEN 'job_status_update'
    WHEN event_type = 'signup' THEN 'extraction_run_started' WHEN event_type = 'purchase' THEN 'extraction_run_completed'
    ELSE 'extraction_run_failed' END AS kind,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 'bad_timestamp'
    WHEN event_id % 13 = 0 THEN 'unknown_event_type' WHEN event_id % 23 = 0 THEN 'bad_run_id' END AS reason
FROM events""",
    "r": "SELECT * FROM rk WHERE kind <> 'cancel' AND reason IS NULL",
    "born": """
SELECT run_id, min(event_seq) AS born,
  min(event_seq) FILTER (WHERE kind IN ('extraction_run_completed', 'extraction_run_failed')) AS ended
FROM r GROUP BY run_id""",
    "cancels": """
SELECT rk.run_id, rk.event_seq, rk.ts, b.ended,
  CASE WHEN b.born IS NULL OR rk.event_seq < b.born THEN 'unknown_run' ELSE 'applied' END AS outcome
FROM rk LEFT JOIN born b ON b.run_id = rk.run_id WHERE rk.kind = 'cancel'""",
    "guarded": """
SELECT run_id, event_seq, CASE WHEN outcome = 'applied' AND (ended < event_seq OR
    min(event_seq) FILTER (WHERE outcome = 'applied') OVER (PARTITION BY run_id) < event_seq)
  THEN 'already_ended' ELSE outcome END AS outcome
FROM cancels""",
    "folded": """
SELECT r.run_id,
  CASE WHEN min_by(kind, event_seq) = 'extraction_run_started'
    THEN min_by(concat('repo-', CAST(user_id % 50 AS VARCHAR)), event_seq) ELSE 'unknown' END AS repository_url,
  CASE WHEN min_by(kind, event_seq) = 'extraction_run_started'
    THEN min_by(concat('b-', CAST(event_seq % 5 AS VARCHAR)), event_seq) ELSE 'main' END AS branch,
  CASE WHEN min_by(kind, event_seq) = 'extraction_run_started' THEN 'api' ELSE 'docker_container' END AS triggered_by,
  coalesce(max_by(CASE kind WHEN 'extraction_run_completed' THEN 'COMPLETED' ELSE 'FAILED' END, event_seq)
    FILTER (WHERE kind IN ('extraction_run_completed', 'extraction_run_failed')), 'STARTED') AS phase,
  min_by(ts, event_seq) AS started_at,
  max_by(ts, event_seq) FILTER (WHERE kind IN ('extraction_run_completed', 'extraction_run_failed')) AS finished_at
FROM r GROUP BY r.run_id""",
    "job_rows": f"""
SELECT {sid("run_id", "event_seq", "0", "sub_seq")} AS job_id, run_id, event_seq, CAST(sub_seq AS INTEGER) AS sub_seq,
  pod_id, status, total_files, processed_files, current_phase, error_count, last_error, ts AS last_updated
FROM (
  SELECT run_id, event_seq, 0 AS sub_seq, pod_id,
    CASE kind WHEN 'extraction_run_failed' THEN 'FAILED' ELSE 'RUNNING' END AS status,
    CASE WHEN kind IN ('progress_update', 'job_status_update') AND event_seq % 4 <> 0 THEN 500 ELSE 0 END AS total_files,
    CASE WHEN kind IN ('progress_update', 'job_status_update') THEN CAST(floor(value) AS INTEGER) ELSE 0 END
      AS processed_files,
    CASE kind WHEN 'extraction_run_started' THEN 'started' WHEN 'extraction_run_completed' THEN 'processing_lineage'
      WHEN 'extraction_run_failed' THEN 'failed' ELSE view_type END AS current_phase,
    CASE kind WHEN 'progress_update' THEN CAST(event_seq % 3 AS INTEGER) ELSE 0 END AS error_count,
    CASE kind WHEN 'extraction_run_failed' THEN props END AS last_error, ts
  FROM r
  UNION ALL
  SELECT run_id, event_seq, 1, pod_id, 'COMPLETED', 0, 0, 'completed', 0, NULL, ts FROM r
  WHERE kind = 'extraction_run_completed')""",
    # Tables that map directly.
    "runs": """
SELECT concat('run-', CAST(o_orderkey AS VARCHAR)) AS run_id, concat('repo-', CAST(o_custkey % 50 AS VARCHAR)) AS repository_url,
  lower(o_orderpriority) AS branch,
  CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'STARTED' ELSE 'FAILED' END AS phase,
  c_mktsegment AS triggered_by, o_orderdate AS started_at,
  CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 DAY END AS finished_at, o_orderdate AS created_at
FROM orders JOIN customer ON o_custkey = c_custkey""",
    "jobs": """
SELECT event_id AS job_id, concat('run-', CAST(user_id AS VARCHAR)) AS run_id, concat('pod-', CAST(event_id % 7 AS VARCHAR)) AS pod_id,
  CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'RUNNING' END AS status,
  event_type AS current_phase, 500 AS total_files, CAST(floor(value) AS INTEGER) AS processed_files, ts AS last_updated
FROM events""",
    "logs": """
SELECT event_id AS log_id, concat('run-', CAST(user_id AS VARCHAR)) AS run_id,
  CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS log_level, props AS message, ts AS log_time, 'docker' AS source
FROM events""",
    "files": """
SELECT d.doc_id AS file_id, concat('run-', CAST(d.doc_id % 100 AS VARCHAR)) AS run_id,
  concat(d.source, '/', CAST(d.doc_id AS VARCHAR), '.sql') AS file_path,
  CASE d.lang WHEN 'en' THEN 'SQL' ELSE 'JINJA2' END AS file_type, md5(d.text) AS file_hash,
  CASE l.quality WHEN 1 THEN 'SUCCESS' WHEN 0 THEN 'FAILED' ELSE 'SKIPPED' END AS status,
  CAST('2024-01-01' AS DATE) + CAST(d.doc_id % 365 AS INTEGER) AS created_at
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
}

NEEDS = {
    "m0": [], "m": ["m0"], "a": ["m"], "cm": ["m"], "col": ["cm"], "x": ["m", "a"], "e": ["x"], "links": ["m", "e"],
    "c": ["a"], "s": ["e"], "nb": ["s", "c"], "tr": ["s", "c"], "cp": ["s", "c"], "ent": ["c", "col", "e"],
    "pairs": ["c", "e"], "deg": ["e"], "rk": [], "r": ["rk"], "born": ["r"], "cancels": ["rk", "born"],
    "guarded": ["cancels"], "folded": ["r"], "job_rows": ["r"], "runs": [], "jobs": [], "logs": [], "files": [],
}


def over(views: str, body: str, lower: bool = False) -> str:
    """`body` over the named views and those they need; `lower`: of the log with all table names in lower case."""
    known = VIEWS | ({"m0": _mentions("lower")} if lower else {})
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in views.split():
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({known[n].strip()})" for n in wanted) + "\n" + body.strip()
