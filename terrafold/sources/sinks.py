"""Sinks for reports."""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_report(report: DataFrame, path: str, fmt: str = "json") -> None:
    """Append report rows; every run adds its own files, so earlier rows are never rewritten."""
    report.write.mode("append").format(fmt).save(path)
