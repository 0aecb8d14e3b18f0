"""Writers: immutable snapshots, one-file reports and append-only logs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_snapshot(rules: DataFrame, path: str, project: str = "project_id", version: str = "version") -> None:
    """Partitioned by project and version; a path that exists is an error, so a snapshot never changes."""
    rules.write.mode("errorifexists").partitionBy(project, version).parquet(path)


def write_report(report: DataFrame, path: str) -> None:
    """A report of a few rows as one JSON file; larger ones should be written as they are."""
    report.coalesce(1).write.mode("overwrite").json(path)


def append_revisions(revisions: DataFrame, path: str) -> None:
    revisions.write.mode("append").parquet(path)
