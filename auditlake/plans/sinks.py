"""Sinks: normalised tables, findings, timeline, file ranges, profiles, cases, report tables.

All writes are Spark writers into directories (one part file per task); a
sorted sink uses ``orderBy`` so part files are in global order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.timefmt import epoch_date
from ..operators import findings as FN, pivots
from ..operators import timeline as TL


def write_normalized(signin: DataFrame, ual: DataFrame, files: DataFrame, outdir: str, mode: str = "overwrite"):
    """``sink_normalized``: event tables partitioned by UTC event date and clustered by user.

    Range partitioning on (event_date, user, ts_epoch) samples the key
    distribution, so a busy day or a hot user is split over many tasks (no
    task owns a whole day), while each output file still covers a narrow
    date / user range; ``files`` keeps the newest row per path."""
    for name, df in (("signin", signin), ("ual", ual)):
        (df.withColumn("event_date", F.coalesce(epoch_date("ts_epoch").cast("string"), F.lit("unknown")))
         .repartitionByRange("event_date", "user", "ts_epoch")  # without a number, adaptive execution sizes the tasks
         .sortWithinPartitions("event_date", "user", "ts_epoch")
         .write.mode(mode).partitionBy("event_date").parquet(f"{outdir}/{name}"))
    latest = Window.partitionBy("path").orderBy(F.desc("file_id"))
    (files.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").drop("_rn")
     .write.mode(mode).parquet(f"{outdir}/files"))


def write_findings(findings: DataFrame, outdir: str) -> None:
    """``sink_findings``: sorted ``findings.csv`` and ``findings.jsonl`` with nested evidence."""
    cols = [c for c in findings.columns if c != "detector_no"]
    FN.sort_findings(findings.select(*cols)).write.mode("overwrite").option("header", True) \
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False) \
        .csv(f"{outdir}/findings.csv")
    (findings.select(*[c for c in cols if c != "evidence_json"],
                     F.try_parse_json("evidence_json").alias("evidence"))
     .write.mode("overwrite").json(f"{outdir}/findings.jsonl"))


def write_timeline(signin: DataFrame, ual: DataFrame, outdir: str, mode: str = "deep") -> None:
    tl = TL.union_timeline(signin, ual, mode)
    tl.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{outdir}/timeline.csv")
    TL.union_timeline(signin, ual, mode, sort=False).write.mode("overwrite").json(f"{outdir}/timeline.jsonl")


def write_file_ranges(files: DataFrame, outdir: str) -> None:
    pivots.file_ranges(files).write.mode("overwrite").option("header", True).option("escape", '"') \
        .csv(f"{outdir}/file_ranges.csv")


def write_schema_profiles(profiles: DataFrame | None, outdir: str) -> None:
    if profiles is None:
        return
    profiles.orderBy("file_id", "pos").write.mode("overwrite").json(f"{outdir}/schema_profiles.json")


def write_cases(signin: DataFrame, ual: DataFrame, outdir: str, max_users: int = 50, last_n: int = 200) -> None:
    """``sink_cases``: per-user summary and last events, partitioned by the file-safe user key."""
    top = pivots.agg_top_case_users(signin, ual, max_users)
    summary = pivots.agg_user_signin_summary(signin, top)
    summary.join(top, "user").write.mode("overwrite").json(f"{outdir}/cases/summary")
    ev = TL.last_n_user_events(signin, ual, last_n, users=top)
    (ev.repartition("user_key").sortWithinPartitions("user_key", "ts_epoch", "_src", "file_id", "rownum")
     .select(*TL.CASE_COLUMNS, "user_key")
     .write.mode("overwrite").partitionBy("user_key").json(f"{outdir}/cases/events"))


def report_tables(findings: DataFrame, signin: DataFrame, ual: DataFrame, files: DataFrame) -> dict:
    """Every pivot of the report as a named DataFrame (``sink_report_tables``)."""
    from ..operators import bec, report_counts
    return {
        **report_counts.count_tables(findings, signin, ual, files),
        "coverage": pivots.agg_coverage(files),
        "families": pivots.agg_family_counts(files),
        "files": pivots.list_files(files),
        "findings": FN.topk_findings_embed(findings),
        "high_findings": FN.topk_high_findings(findings),
        "timeline": FN.findings_timeline(findings),
        "bec_forwarding_events": bec.bec_forwarding_events(ual),
        "bec_inbox_rule_events": bec.bec_inbox_rule_events(ual),
        "bec_delegation_events": bec.bec_delegation_events(ual),
        "bec_external_forward_domains_top": bec.bec_external_domains(ual, K.TOP_DOMAINS),
        "bec_events": bec.union_bec_events(ual, K.BEC_EVENTS_PER_KIND, K.REPORT_TIMELINE_TOP),
    }


def write_report_tables(tables: dict, outdir: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{outdir}/report/{name}")
