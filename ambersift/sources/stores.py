"""Scan history, baselines and the relational findings store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.compare import make_baseline

SCAN_RECORD = (
    "timestamp timestamp, project_path string, report struct<security_score:int, results:array<struct<"
    "id:string,name:string,status:string,severity:string,file:string,line:int,evidence:string,suggestion:string>>>"
)


def read_scan_history(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON scan snapshots. ``multi_line`` for one indented document per file; a
    large scan is better kept as JSON lines, several lines per scan if need be."""
    return spark.read.schema(SCAN_RECORD).option("multiLine", str(multi_line).lower()).json(path)


def scan_results(history: DataFrame) -> DataFrame:
    return history.select("project_path", "timestamp", F.explode("report.results").alias("r")).select(
        "project_path", "timestamp", F.col("r.id").alias("rule_id"), "r.name", "r.status", "r.severity", "r.file",
        "r.line", "r.evidence", "r.suggestion",
    )


def latest_scan_results(history: DataFrame) -> DataFrame:
    """Results of the newest scan of every project."""
    newest = history.groupBy("project_path").agg(F.max("timestamp").alias("timestamp"))
    return scan_results(history).join(newest, ["project_path", "timestamp"], "left_semi")


def write_baseline(findings: DataFrame, path: str) -> None:
    make_baseline(findings).write.mode("overwrite").parquet(path)


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


STORE = {
    "products": (
        "id long, name string, description string, repo_url string, lifecycle string, origin string,"
        " business_criticality string, platform string, tech_stack string, sla_critical int, sla_high int,"
        " sla_medium int, sla_low int, created_at timestamp_ntz, updated_at timestamp_ntz"
    ),
    "members": "product_id long, user_id long, role string",
    "engagements": (
        "id long, product_id long, name string, description string, scan_path string, engagement_type string,"
        " status string, started_at timestamp_ntz, completed_at timestamp_ntz"
    ),
    "findings": (
        "id long, engagement_id long, product_id long, rule_id string, title string, severity string,"
        " cvss_score double, cve_id string, cwe_id string, file_path string, line_number int, col_number int,"
        " code_snippet string, description string, impact string, fix_suggestion string, hash_code string,"
        " is_duplicate boolean, duplicate_of long, status string, kanban_column string, sla_deadline timestamp_ntz,"
        " sla_breached boolean, is_verified boolean, verified_at timestamp_ntz, created_at timestamp_ntz,"
        " updated_at timestamp_ntz, resolved_at timestamp_ntz, is_false_positive boolean, fp_reason string,"
        " stack string, ai_triage_status string, ai_triage_summary string, verification_status string,"
        " verification_summary string"
    ),
    "notes": "id long, finding_id long, author_id long, content string, note_type string, created_at timestamp_ntz",
    "audit_log": (
        "id long, user_id long, action string, entity_type string, entity_id long, old_value string,"
        " new_value string, created_at timestamp_ntz"
    ),
    "notifications": (
        "id long, user_id long, title string, body string, type string, is_read boolean, created_at timestamp_ntz"
    ),
    "ignored": (
        "id long, vuln_id string, rule_id string, file_path string, line_number int, code_snippet string,"
        " content_hash string, reason string"
    ),
    "runs": "id long, product_id long, status string, current_step int, created_at timestamp_ntz",
    "artifacts": "id long, run_id long, kind string, media_type string, sha256 string",
}
# Column defaults of the store.
DEFAULTS = {
    "products": {
        "lifecycle": "production", "origin": "internal", "business_criticality": "high",
        "sla_critical": 1, "sla_high": 7, "sla_medium": 30, "sla_low": 90,
    },
    "members": {"role": "viewer"},
    "engagements": {"engagement_type": "ci_cd", "status": "in_progress"},
    "findings": {
        "status": "open", "kanban_column": "backlog", "is_duplicate": False, "sla_breached": False,
        "is_verified": False, "is_false_positive": False,
    },
    "notes": {"note_type": "comment"},
    "notifications": {"type": "info", "is_read": False},
    "ignored": {"line_number": 0, "reason": "False Positive"},
    "runs": {"status": "in_progress", "current_step": 0},
}


def with_defaults(table: str, df: DataFrame) -> DataFrame:
    known = {c: v for c, v in DEFAULTS.get(table, {}).items() if c in df.columns}
    return df.fillna(known) if known else df


def read_findings_store(spark: SparkSession, path: str, tables: list[str] | None = None) -> dict[str, DataFrame]:
    """The relational tables as DataFrames with their column defaults filled in."""
    return {
        name: with_defaults(name, spark.read.schema(STORE[name]).parquet(f"{path}/{name}"))
        for name in tables or STORE
    }


def read_findings_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A store table through JDBC; give partitionColumn, bounds and numPartitions for large ones."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    return with_defaults(table, reader.options(**options).load())


def write_findings_store(findings: DataFrame, path: str) -> None:
    findings.write.mode("overwrite").partitionBy("product_id").parquet(path)
