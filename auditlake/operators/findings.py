"""Findings-level operators: union, sort orders, top-k report views, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.predicates import severity_rank
from ..functions.jsonfn import compress_evidence
from ..functions.text import compress_text, nz
from ..functions.timefmt import parse_epoch
from ..schema import FINDING_COLUMNS
from .positions import with_position


def union_findings(parts: list[tuple[int, DataFrame]]) -> DataFrame:
    """Concatenate detector outputs with their fixed detector number (``detector_no``)."""
    out = None
    for no, df in parts:
        if df is None:
            continue
        d = df.select(*FINDING_COLUMNS).withColumn("detector_no", F.lit(no))
        out = d if out is None else out.unionByName(d)
    return out


def with_order_keys(findings: DataFrame) -> DataFrame:
    return (findings
            .withColumn("_rank_csv", severity_rank("severity", K.SEVERITY_RANK_FINDINGS_CSV))
            .withColumn("_rank_rep", severity_rank("severity", K.SEVERITY_RANK_REPORT))
            .withColumn("_ts_epoch", parse_epoch(F.col("timestamp"))))


def _csv_order() -> list:
    """severity rank (high, medium, low, info, other), then time, unparseable last."""
    return [F.col("_rank_csv"), F.col("_ts_epoch").asc_nulls_last(), F.col("finding_id")]


def _report_order() -> list:
    """severity rank (critical, high, medium, low, other), then timestamp text."""
    return [F.col("_rank_rep"), F.col("timestamp"), F.col("finding_id")]


def sort_findings(findings: DataFrame) -> DataFrame:
    """``findings.csv`` order."""
    return with_order_keys(findings).orderBy(*_csv_order()).drop("_rank_csv", "_rank_rep", "_ts_epoch")


def sort_findings_report(findings: DataFrame) -> DataFrame:
    """Report order."""
    return with_order_keys(findings).orderBy(*_report_order()).drop("_rank_csv", "_rank_rep", "_ts_epoch")


def findings_with_position(findings: DataFrame, report: bool = False) -> DataFrame:
    """Findings with their ``position`` from 1 on in the ``findings.csv`` or the report order."""
    order = _report_order() if report else _csv_order()
    return with_position(with_order_keys(findings), *order).drop("_rank_csv", "_rank_rep", "_ts_epoch")


def topk_findings_embed(findings: DataFrame, top: int = K.REPORT_EMBED_TOP,
                        max_len: int = K.REPORT_TEXT_MAX) -> DataFrame:
    """First ``top`` report-ordered findings with details / evidence text trimmed."""
    f = with_order_keys(findings).orderBy("_rank_rep", "timestamp", "finding_id").limit(top)
    return f.select(*[c for c in FINDING_COLUMNS if c not in ("details", "evidence_json")],
                    compress_text("details", max_len).alias("details"),
                    compress_evidence("evidence_json", max_len).alias("evidence_json"))


def topk_high_findings(findings: DataFrame, top: int = K.TOP_HIGH_FINDINGS) -> DataFrame:
    """First ``top`` high findings in detector order, then file / row / id."""
    f = findings.filter(F.lower("severity") == "high")
    return (f.orderBy("detector_no", F.expr("try_cast(file AS BIGINT)").asc_nulls_last(),
                      F.expr("try_cast(rownum AS BIGINT)").asc_nulls_last(), "finding_id").limit(top))


def findings_timeline(findings: DataFrame, top: int = K.REPORT_TIMELINE_TOP) -> DataFrame:
    """First ``top`` report-ordered findings that carry a timestamp, chronologically."""
    f = with_order_keys(findings).orderBy("_rank_rep", "timestamp", "finding_id").limit(top)
    f = f.filter(nz("timestamp") != "")
    return (f.select(F.col("timestamp").alias("ts"), "severity", "title", "category", "user", "ip",
                     F.when((nz("file") != "") & (nz("rownum") != ""), F.concat_ws(":", "file", "rownum"))
                     .otherwise(F.lit("")).alias("ref"), "finding_id", "_ts_epoch")
            .orderBy(F.col("_ts_epoch").asc_nulls_first(), "finding_id").drop("_ts_epoch"))


def filter_findings_search(findings: DataFrame, severity: str | None = None, category: str | None = None,
                           query: str | None = None) -> DataFrame:
    """Findings by severity, category and free-text substring over ten fields."""
    f = findings
    if severity:
        f = f.filter(F.lower(nz("severity")) == severity.lower())
    if category:
        f = f.filter(F.col("category") == category)
    q = (query or "").lower().strip()
    if q:
        blob = F.lower(F.concat_ws(" ", *[nz(c) for c in ("finding_id", "severity", "category", "title", "timestamp",
                                                          "user", "ip", "file", "rownum", "details")]))
        f = f.filter(blob.contains(q))
    return f


def list_findings_categories(findings: DataFrame) -> DataFrame:
    return findings.filter(nz("category") != "").select("category").distinct().orderBy("category")
