"""Stored table schemas: experiment runs and metrics, integration documents, and the contract of each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

EXPERIMENT_TABLES = {
    "runs": "run_id bigint, experiment bigint, status string, started_at timestamp_ntz, tags array<string>, params map<string,string>",
    "metrics": "run_id bigint, metric_name string, epoch int, step bigint, metric_value double, ts timestamp_ntz",
}

INTEGRATION_TABLES = {
    "integrations": "integration_id string, repo_url string, paper_url string, status string, mode string, current_phase int, confidence double, created_at timestamp_ntz, "
                    "updated_at timestamp_ntz, error_message string, guardrail_reasons array<string>, retry_count int, branch_name string",
    "validation_runs": "integration_id string, baseline_metrics map<string,double>, new_metrics map<string,double>, passed boolean, logs string, created_at timestamp_ntz",
    "approvals": "integration_id string, phase int, action string, notes string, created_at timestamp_ntz",
    "integration_logs": "integration_id string, message string, level string, ts timestamp_ntz",
    "paper_library": "paper_id string, paper_title string, paper_url string, arxiv_id string, algorithm_name string, analysis_date timestamp_ntz, integration_count bigint, last_used timestamp_ntz, notes string",
    "session_history": "integration_id string, action string, status string, repo_path string, spec_name string, duration double, created_at timestamp_ntz, summary string",
}
# The literals a column may hold.
LITERALS = {
    "integrations": {
        "status": ["pending", "phase1_analyzing", "phase2_extracting", "phase3_mapping", "phase4_patching", "phase5_validating", "phase6_reporting",
                   "awaiting_approval", "completed", "failed"],
        "mode": ["step_approval", "autonomous"],
    },
    "approvals": {"action": ["approved", "rejected"]},
}
# Columns that may be null; all others are required.
OPTIONAL = {
    "integrations": ["paper_url", "confidence", "error_message", "guardrail_reasons", "branch_name"],
    "validation_runs": ["baseline_metrics", "new_metrics"],
    "approvals": ["notes"],
    "integration_logs": ["level"],
    "paper_library": ["paper_url", "arxiv_id", "algorithm_name", "notes"],
    "session_history": ["spec_name", "summary"],
}
# How each table is laid out: partition column, then the order inside files, after the lookups it serves.
LAYOUT = {
    "integrations": (["status"], ["created_at"]),
    "validation_runs": ([], ["integration_id"]),
    "approvals": ([], ["integration_id"]),
    "integration_logs": ([], ["integration_id", "ts"]),
    "paper_library": ([], ["analysis_date", "algorithm_name"]),
    "session_history": ([], ["integration_id", "created_at"]),
}


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], {**EXPERIMENT_TABLES, **INTEGRATION_TABLES}[name])


def conform(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with the table's columns and types; columns they lack are null."""
    schema = empty_table(rows.sparkSession, name).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def contract_violations(df: DataFrame, name: str) -> DataFrame:
    """(rule, n) of a table, one pass: its rows, nulls in required columns, values outside the literals; rules that hold are left out."""
    rules = [("rows", F.lit(True))]
    rules += [(f"{c} is null", F.col(c).isNull()) for c in df.columns if c not in OPTIONAL.get(name, [])]
    rules += [(f"{c} is no literal", ~F.col(c).isin(*values)) for c, values in LITERALS.get(name, {}).items()]
    counts = df.agg(*[F.count_if(test).alias(f"r{i}") for i, (_, test) in enumerate(rules)])
    pairs = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(f"r{i}").alias("n")) for i, (rule, _) in enumerate(rules)])
    return counts.select(F.inline(pairs)).filter("n > 0")
