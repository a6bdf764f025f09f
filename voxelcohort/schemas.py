"""Explicit schemas of the canonical tables, as DDL."""

SERIES = (
    "series_id STRING, accession STRING, series_index INT, patient_id STRING, timepoint STRING,"
    " scan_order INT, days INT, tracker STRING, study_type STRING, study_labels STRING,"
    " image_path STRING, seg_path STRING, file_size_mb DOUBLE, entropy DOUBLE, voxel_volume DOUBLE,"
    " voxel_unit STRING, volume_unit STRING, segmentation_volume DOUBLE, spacing ARRAY<DOUBLE>,"
    " multiple_masks BOOLEAN, coreg_image STRING, coreg_seg STRING, overlay STRING,"
    " preprocessing_version STRING, anchor STRING, mi DOUBLE, error_details STRING, error_ts TIMESTAMP"
)
CHUNKS = (
    "volume_id STRING, shape ARRAY<INT>, spacing ARRAY<DOUBLE>, unit STRING,"
    " bi INT, bj INT, bk INT, origin ARRAY<INT>, dims ARRAY<INT>, data ARRAY<FLOAT>"
)
SPLIT_NAMES = ("train", "val", "test")
SPLIT_TYPE = "ARRAY<STRUCT<patient_id: STRING, scans: ARRAY<STRUCT<scan_id: STRING, days_since_first: DOUBLE>>>>"
SPLITS = ", ".join(f"{name} {SPLIT_TYPE}" for name in SPLIT_NAMES)
GRAPH = (
    "nodes ARRAY<STRUCT<id: STRING, label: STRING, community: INT, file_type: STRING, source_file: STRING,"
    " source_location: STRING, summary: STRING, description: STRING, note: STRING>>,"
    " links ARRAY<STRUCT<source: STRING, target: STRING, relation: STRING, confidence: STRING>>"
)
