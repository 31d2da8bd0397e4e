"""All counting pivots of the report from one pass over each table.

Each table is aggregated once with grouping sets and written; the pivots read
that small table.  Distinct counts need no sets of their own: a pair (address,
user) is one row, so the rows of an address are its distinct users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import nz
from ..functions.timefmt import epoch_date_str, epoch_dow, epoch_hour, parse_epoch
from ..session import cut_lineage
from . import pivots


def _sets(df: DataFrame, sets: list[list[str]], *aggs) -> DataFrame:
    """Grouping sets with the name of each, its columns joined, in ``_set``; absent columns are null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    out = df.groupingSets(sets, *columns).agg(F.grouping_id().alias("_gid"), *aggs)
    names = {sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in s): "+".join(s) for s in sets}
    name = F.lit("")
    for gid, text in names.items():
        name = F.when(F.col("_gid") == gid, text).otherwise(name)
    return out.withColumn("_set", name).drop("_gid")


def signin_counts(signin: DataFrame) -> DataFrame:
    """Sign-ins by (ip, user), by date and by (day of week, hour)."""
    strict = F.col("ts_epoch").isNotNull() & P.sql_failure()
    rows = signin.select(
        nz("ip").alias("ip"), nz("user").alias("user"), epoch_date_str("ts_epoch").alias("date"), epoch_dow("ts_epoch").alias("dow"),
        epoch_hour("ts_epoch").alias("hour"), F.when(P.dashboard_failure(), 1).otherwise(0).alias("dash"), F.when(strict, 1).otherwise(0).alias("strict"))
    return _sets(rows, [["ip", "user"], ["date"], ["dow", "hour"]], F.count(F.lit(1)).alias("n"), F.sum("dash").alias("dash"),
                 F.sum("strict").alias("strict"))


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, category, user, ip, country and date."""
    date = epoch_date_str(F.when(nz("timestamp") != "", parse_epoch(F.col("timestamp"))))
    rows = findings.select(F.lower(nz("severity")).alias("severity"), "category", nz("user").alias("user"), nz("ip").alias("ip"),
                           nz("country").alias("country"), date.alias("date"))
    return _sets(rows, [[c] for c in ("severity", "category", "user", "ip", "country", "date")], F.count(F.lit(1)).alias("n"))


def ual_counts(ual: DataFrame) -> DataFrame:
    """Audit rows by date."""
    return _sets(ual.select(epoch_date_str("ts_epoch").alias("date")), [["date"]], F.count(F.lit(1)).alias("n"))


def _top(df: DataFrame, order: list, top: int | None) -> DataFrame:
    return df.orderBy(*order).limit(top) if top is not None else df


def count_tables(findings: DataFrame, signin: DataFrame, ual: DataFrame, files: DataFrame) -> dict:
    """The counting pivots of the report by name, equal to those of ``pivots``; each big table is read once."""
    s, f, u = (cut_lineage(x) for x in (signin_counts(signin), finding_counts(findings), ual_counts(ual)))

    def of(df: DataFrame, name: str) -> DataFrame:
        return df.where(F.col("_set") == name)

    def by_date(df: DataFrame) -> DataFrame:
        return of(df, "date").where("date is not null").select("date", F.col("n").alias("count")).orderBy("date")

    def failures(key: str, other: str) -> DataFrame:
        pairs = of(s, "ip+user").where(F.col(key) != "")
        out = pairs.groupBy(key).agg(F.sum("dash").alias("fails"), F.count(F.lit(1)).alias(other))
        return _top(out, [F.desc("fails"), F.desc(other), F.asc(key)], K.TOP_DASH_FAIL)

    def strict(key: str) -> DataFrame:
        out = of(s, "ip+user").where(F.col(key) != "").groupBy(key).agg(F.sum("strict").alias("fails")).where("fails > 0")
        return _top(out, [F.desc("fails"), F.asc(key)], K.TOP_FAIL)

    severity = of(f, "severity").select("severity", F.col("n").alias("count"))
    grid = s.sparkSession.range(7 * 24).select((F.col("id") / 24).cast("long").alias("dow"), F.pmod(F.col("id"), F.lit(24)).alias("hour"))
    hours = of(s, "dow+hour").where("dow is not null").select("dow", "hour", "n")
    weight = F.lit(0)
    for name, points in K.RISK_SCORE_WEIGHTS.items():
        weight = F.when(F.col("severity") == name, points).otherwise(weight)
    score = F.least(F.lit(K.RISK_SCORE_CAP).cast("long"), F.coalesce(F.sum(F.col("count") * weight), F.lit(0)).cast("long"))
    risk = severity.agg(score.alias("risk_score"))
    parts = {"risk_score": risk.select(F.col("risk_score").alias("v")), "total_files": files.agg(F.count(F.lit(1)).alias("v")),
             "total_findings": severity.agg(F.sum("count").alias("v"))}
    for name, column in (("impacted_users", "user"), ("impacted_ips", "ip")):
        parts[name] = of(f, column).where(F.col(column) != "").agg(F.count(F.lit(1)).alias("v"))
    for name, df in (("signin_rows", of(s, "dow+hour")), ("ual_rows", u)):
        parts[name] = df.agg(F.sum("n").alias("v"))
    long = None
    for name, df in parts.items():
        own = df.select(F.lit(name).alias("metric"), F.coalesce(F.col("v"), F.lit(0)).cast("long").alias("v"))
        long = own if long is None else long.unionByName(own)
    signin_day, ual_day, findings_day = by_date(s), by_date(u), by_date(f)
    return {
        "kpis": long.groupBy().pivot("metric", list(parts)).agg(F.first("v")),
        "risk_score": risk.select("risk_score", pivots.risk_label(F.col("risk_score")).alias("risk_label")),
        "severity_counts": severity,
        "category_top": _top(of(f, "category").select("category", F.col("n").alias("count")), [F.desc("count"), F.asc("category")], K.TOP_CATEGORIES),
        "categories": of(f, "category").where("category != ''").select("category").orderBy("category"),
        "impacted_users": of(f, "user").where(F.col("user") != "").select("user"),
        "impacted_ips": of(f, "ip").where("ip != ''").select("ip"),
        "impacted_countries_top": _top(of(f, "country").where("country != ''").select("country", F.col("n").alias("count")),
                                       [F.desc("count"), F.asc("country")], K.TOP_COUNTRIES),
        "top_signin_fail_ips": failures("ip", "users"),
        "top_signin_fail_users": failures("user", "ips"),
        "report_fail_ips": strict("ip"),
        "report_fail_users": strict("user"),
        "signin_by_day": signin_day,
        "ual_by_day": ual_day,
        "findings_by_day": findings_day,
        "daily": pivots.join_daily_series(signin_day, ual_day, findings_day),
        "signin_heatmap_dow_hour": F.broadcast(grid).join(F.broadcast(hours), ["dow", "hour"], "left").select(  # at most 168 rows each
            "dow", "hour", F.coalesce("n", F.lit(0)).cast("long").alias("count")),
    }
