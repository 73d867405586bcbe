"""Schemas of the tables and in-memory frames (SNK-11: the one place where they are declared)."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(), "double": T.DoubleType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def ddl(text: str) -> T.StructType:
    """A schema from ``name type, ...``, without a session."""

    def kind(t: str) -> T.DataType:
        return T.DecimalType(*map(int, re.findall(r"\d+", t))) if t.startswith("decimal") else _TYPES[t]

    return T.StructType([T.StructField(n, kind(t)) for n, t in re.findall(r"(\w+) ([^,(]+(?:\([^)]*\))?)", text)])


LLM_CALL_METRICS = ddl("id string, task_id string, stage string, provider string, model string, input_tokens int, output_tokens int, cache_hit_tokens int, latency_ms int, success boolean, error_type string, is_estimated boolean, is_streaming boolean, first_token_latency_ms int, created_at timestamp")
TASKS = ddl("id string, task_type string, status string, repository_id string, source_branch string, request_hash string, provider string, model string, total_prompt_tokens int, total_completion_tokens int, current_stage string, last_successful_stage string, auto_resume_fail_count int, created_at timestamp, updated_at timestamp, started_at timestamp, completed_at timestamp")
TASK_ARTIFACTS = ddl("id string, task_id string, artifact_type string, artifact_key string, stage_name string, status string, sequence int, content_hash string, summary string, payload_json string, created_at timestamp")
TASK_CALL_LOGS = ddl("id string, task_id string, step_order int, call_type string, provider string, model string, prompt_tokens int, completion_tokens int, total_tokens int, latency_ms int, is_error boolean, created_at timestamp")
REPOSITORIES = ddl("id string, provider_type string, provider_repository_key string, display_name string, owner string, repo_name string, repo_type string, repo_url string, default_branch string, default_language string, created_at timestamp")
REPOSITORY_VERSIONS = ddl("id string, repository_id string, branch_name string, commit_sha string, commit_time timestamp, source_status string, is_latest_on_branch boolean, created_at timestamp")
WIKI_SPACES = ddl("id string, repository_id string, language string, view_type string, published_wiki_version_id string")
WIKI_VERSIONS = ddl("id string, wiki_space_id string, repository_version_id string, version_no int, status string, page_count int, created_at timestamp")
WIKI_PAGES = ddl("id string, wiki_version_id string, page_order int, title string, nav_title string, content_markdown string, parent_page_id string, page_type string, importance string, depth int, file_paths array<string>, token_count int, status string")
WIKI_PAGE_RELATIONS = ddl("wiki_version_id string, source_page_id string, target_page_id string, relation_type string, metadata_json string")
PROVIDER_MODEL_METADATA = ddl("provider_key string, model_name string, billing_type string, max_context_tokens int, max_output_tokens int, rate_limit_per_minute int, input_token_price decimal(10,6), output_token_price decimal(10,6), call_price decimal(10,6), context_fill_ratio double")
PROMPT_TEMPLATES = ddl("id string, slug string, name string, category string, sub_category string, template_content string, priority int, applicable_providers array<string>, is_active boolean, version int")
PROMPT_OVERRIDES = ddl("repository_id string, prompt_template_id string, override_content string, strategy string, priority int, is_enabled boolean")
CODE_INDEX_ENTRIES = ddl("file_path string, module_name string, file_type string, language string, size_bytes bigint, importance_score int, exported_symbols array<string>, dependency_hints array<string>")
AST_SYMBOL = ddl("name string, kind string, full_signature string, file_path string, start_line int, end_line int, parent_class string, modifiers array<string>, base_types array<string>, attribute_annotations array<string>")
CALL_EDGE = ddl("caller_symbol string, caller_file_path string, callee_symbol string, callee_file_path string, call_type string, confidence double")
SOURCE_CHUNK = ddl("start_line int, end_line int, label string, content string")
AST_FILE = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("symbols", T.ArrayType(AST_SYMBOL)),
        T.StructField("call_edges", T.ArrayType(CALL_EDGE)),
        T.StructField("chunks", T.ArrayType(SOURCE_CHUNK)),
        T.StructField("design_pattern_hints", T.ArrayType(T.StringType())),
        T.StructField("cst_s_expression", T.StringType()),
    ]
)
BM25_DOC = ddl("file_path string, module_name string, content string, symbols string, title string, language string, start_line int, end_line int")
CONTEXT_SEGMENT = ddl("label string, content string, priority int, can_truncate boolean")


def snake_case(df: DataFrame) -> DataFrame:
    """SNK-11: PascalCase column names to snake_case."""
    return df.withColumnsRenamed({c: re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", c).lower() for c in df.columns})
