"""Schemas of the stored tables. Reading states them, so an empty table reads as empty.

Ids and enums are text, times have no zone, `stats` keeps its JSON types, lists of one event stay nested in
`decoded` only. `edges` holds kept and skipped edges; `lineage` is its kept part.
"""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "decoded": """
        run_id STRING, event_seq BIGINT, event_tie BIGINT, event_type STRING, pod_id STRING,
        event_time TIMESTAMP_NTZ, reason STRING, makes_run BOOLEAN,
        file STRUCT<filePath: STRING, fileUrl: STRING, fileHash: STRING, fileType: STRING, status: STRING>,
        tables ARRAY<STRUCT<name: STRING, role: STRING, schema: STRING, columns: ARRAY<STRING>>>,
        tables_any ARRAY<STRUCT<name: STRING, role: STRING, schema: STRING, columns: ARRAY<STRING>>>,
        edges ARRAY<STRUCT<from_table: STRING, to_table: STRING, from_column: STRING, to_column: STRING,
            edge_type: STRING, transformation_type: STRING,
            transformation_lines: VARIANT>>,
        edges_any ARRAY<STRUCT<from_table: STRING, to_table: STRING, from_column: STRING, to_column: STRING,
            edge_type: STRING, transformation_type: STRING>>,
        edge_starts STRUCT<s1: INT, s2: INT, s3: INT, s4: INT>,
        started STRUCT<repositoryUrl: STRING, branch: STRING, triggeredBy: STRING>,
        progress STRUCT<currentFile: STRING, currentPhase: STRING, totalFiles: INT, processedFiles: INT,
            errorCount: INT>,
        error STRING, stats VARIANT, line STRING""",
    "extraction_runs": """
        run_id STRING, repository_url STRING, branch STRING, commit_hash STRING, run_mode STRING, phase STRING,
        triggered_by STRING, extractor_version STRING, started_at TIMESTAMP_NTZ, finished_at TIMESTAMP_NTZ,
        stats VARIANT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ, run_bucket INT""",
    "run_facts": """
        run_id STRING,
        first STRUCT<event_seq: BIGINT, event_tie: BIGINT, by_start: BOOLEAN, repository_url: STRING,
            branch: STRING, triggered_by: STRING, at: TIMESTAMP_NTZ>,
        terminal STRUCT<event_seq: BIGINT, event_tie: BIGINT, phase: STRING, at: TIMESTAMP_NTZ>,
        stats_at STRUCT<event_seq: BIGINT, event_tie: BIGINT>, stats VARIANT,
        last STRUCT<event_seq: BIGINT, event_tie: BIGINT>, run_bucket INT""",
    "job_status": """
        job_id STRING, run_id STRING, event_seq BIGINT, event_tie BIGINT, sub_seq INT, pod_id STRING,
        status STRING, total_files INT, processed_files INT, succeeded_files INT, failed_files INT,
        current_file STRING, processing_speed DECIMAL(10,2), estimated_time_remaining DECIMAL(10,2),
        current_phase STRING, error_count INT, last_error STRING, last_updated TIMESTAMP_NTZ,
        created_at TIMESTAMP_NTZ, run_bucket INT""",
    "files": """
        file_id STRING, run_id STRING, event_seq BIGINT, event_tie BIGINT, file_path STRING, file_type STRING,
        file_url STRING, file_hash STRING, extracted_at TIMESTAMP_NTZ, status STRING, created_at TIMESTAMP_NTZ,
        run_bucket INT""",
    "assets": """
        asset_id STRING, run_id STRING, full_name STRING, short_name STRING, schema_name STRING, role STRING,
        created_at TIMESTAMP_NTZ, first_seq BIGINT, first_tie BIGINT, first_pos INT, run_bucket INT""",
    "asset_columns": """
        asset_column_id STRING, asset_id STRING, run_id STRING, short_name STRING, column_name STRING, role STRING,
        created_at TIMESTAMP_NTZ, run_bucket INT""",
    "column_facts": """
        asset_column_id STRING, asset_id STRING, run_id STRING, short_name STRING, column_name STRING, role STRING,
        created_at TIMESTAMP_NTZ, first_seq BIGINT, first_tie BIGINT, first_pos INT, run_bucket INT""",
    "late_names": """
        run_id STRING, short_name STRING, at STRUCT<event_seq: BIGINT, event_tie: BIGINT>""",
    "landed": """
        tag STRING, run_id STRING, event_seq BIGINT, event_tie BIGINT, d1 BIGINT, d2 BIGINT, value STRING""",
    "odd": "d1 BIGINT, d2 BIGINT, taken BOOLEAN",
    "asset_files": """
        asset_file_id STRING, run_id STRING, file_id STRING, asset_id STRING, side STRING,
        created_at TIMESTAMP_NTZ, run_bucket INT""",
    "edges": """
        lineage_id STRING, run_id STRING, event_seq BIGINT, event_tie BIGINT, pos INT, file_id STRING,
        file_path STRING, from_asset_id STRING, to_asset_id STRING, from_short STRING, from_full STRING,
        to_short STRING, to_full STRING, from_column STRING, to_column STRING, edge_type STRING,
        transformation_type STRING, start_line INT, end_line INT, created_at TIMESTAMP_NTZ, skip_reason STRING,
        skipped BOOLEAN, run_bucket INT""",
    "quarantine": """
        run_id STRING, event_seq BIGINT, event_tie BIGINT, item STRING, pos INT, reason STRING, line STRING""",
    "extraction_logs": """
        log_id STRING, run_id STRING, log_level STRING, message STRING, log_time TIMESTAMP_NTZ, source STRING,
        log_date DATE""",
}


#: What the ids of a table follow from, where its stated columns do not have it; `ids_follow` is true in rows stored without ids.
_PLACES = {
    "assets": "",
    "files": "",
    "edges": "",
    "asset_columns": "first_seq BIGINT, first_tie BIGINT, first_pos INT, column_pos INT, ",
    "column_facts": "column_pos INT, ",
    "asset_files": "event_seq BIGINT, event_tie BIGINT, pos INT, short_name STRING, ",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


def stored_schema(name: str) -> StructType:
    """All columns that files of the table may have."""
    return StructType.fromDDL(_DDL[name] + (f", {_PLACES[name]}ids_follow BOOLEAN" if name in _PLACES else ""))
