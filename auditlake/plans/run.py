"""End-to-end triage of an exported log folder.

Stages (each boundary is a written table, so a lost executor only re-runs
the current stage):
1. ingest: CSV folder -> normalised ``signin`` / ``ual`` / ``files`` Parquet
2. detect: all detectors -> ``findings`` Parquet (written once)
3. report: findings / timeline / file ranges / profiles / cases / pivots
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..sources.logs import ingest_logs, profile_from_table
from . import sinks
from .triage import TriageParams, detect_all


def run_triage(spark: SparkSession, logdir: str, outdir: str, mode: str = "deep", rules=None,
               params: TriageParams | None = None) -> dict:
    """Run the whole triage; returns the written tables as DataFrames read back from ``outdir``."""
    p = params or TriageParams(mode=mode)
    if p.mode != mode:
        from dataclasses import replace
        p = replace(p, mode=mode)
    raw = ingest_logs(spark, logdir)
    sinks.write_normalized(raw["signin"], raw["ual"], raw["files"], f"{outdir}/tables")
    signin = spark.read.parquet(f"{outdir}/tables/signin").drop("event_date")
    ual = spark.read.parquet(f"{outdir}/tables/ual").drop("event_date")
    files = spark.read.parquet(f"{outdir}/tables/files")

    detect_all(signin, ual, files, rules, p).write.mode("overwrite").parquet(f"{outdir}/tables/findings")
    findings = spark.read.parquet(f"{outdir}/tables/findings")

    sinks.write_findings(findings, outdir)
    sinks.write_file_ranges(files, outdir)
    profiles = profile_from_table(signin).unionByName(profile_from_table(ual))
    sinks.write_schema_profiles(profiles, outdir)
    sinks.write_timeline(signin, ual, outdir, mode)
    if mode != "quick":
        sinks.write_cases(signin, ual, outdir)
    sinks.write_report_tables(sinks.report_tables(findings, signin, ual, files), outdir)
    return {"signin": signin, "ual": ual, "files": files, "findings": findings}
