"""Schemas of the graph's node and edge tables and of the evaluation records, as DDL."""

from __future__ import annotations

FILE = "path string not null, name string, content_hash string, repo_path string, last_modified timestamp, updated_at timestamp, imports array<string>"
FUNCTION = (
    "id string not null, name string, file_path string, start_line int, end_line int, signature string, docstring string, "
    "qualified_name string, module_name string, symbol_key string, class_name string, calls array<string>"
)
CLASS = "id string not null, name string, file_path string, start_line int, end_line int, docstring string, qualified_name string, module_name string, symbol_key string, bases array<string>"
TEST = "id string not null, name string, file_path string, function_name string, test_type string"
METADATA = (
    "id string not null, last_indexed_repo string, path_format string, repo_slug string, last_indexed_commit string, graph_identity string, "
    "repo_fingerprint string, build_mode string, graph_version string, symbol_identity_scheme string, build_warnings_count int, updated_at timestamp"
)

CONTAINS = "src string, dst string, src_label string, dst_label string"
CALLS = "src string, dst string, resolution_method string, resolution_confidence double"
IMPORTS = "src string, dst string"
INHERITS = "src string, dst string, resolution_method string, resolution_confidence double"
TESTS = "src string, dst string, dst_label string, link_source string, link_confidence double, coverage double"
DEPENDS_ON = "src string, dst string, coverage_pct double, link_source string, link_confidence double"

NODES = {"file": FILE, "function": FUNCTION, "class": CLASS, "test": TEST}
EDGES = {"contains": CONTAINS, "calls": CALLS, "imports": IMPORTS, "inherits": INHERITS, "tests": TESTS, "depends_on": DEPENDS_ON}

PREDICTION = (
    "instance_id string, model string, prediction string, error string, "
    "graph_metadata struct<graph_built:boolean,graph_build_time:double,impacted_tests_found:bigint,impact_analysis_time:double>"
)
SCORE_LOG = (
    "timestamp string, prediction_file string, dataset string, num_instances int, generation_score double, evaluation_score double, "
    "evaluation_status string, generation_time double, evaluation_time double, model string, backend string, notes string"
)
REPORT = (
    "instance_id string, patch_is_None boolean, patch_exists boolean, patch_successfully_applied boolean, resolved boolean, "
    "tests_status map<string,struct<success:array<string>,failure:array<string>>>"
)
ATTEMPT = (
    "recorded_at string, attempt int, changed_files array<string>, hypothesis_summary string, rejection_reason string, failure_signature string, "
    "progress_gate_reason string, progress_gate_stagnation_count int, f2p_passed int, f2p_failed int, verify_pass_after_edit boolean, smoke_pass_after_edit boolean"
)
INSTANCE = "instance_id string, repo string, base_commit string, problem_statement string, FAIL_TO_PASS string, PASS_TO_PASS string"
