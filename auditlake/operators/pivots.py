"""Report pivots over sign-ins, audit rows, files and findings.

All are plain aggregations (partial + final); top-k lists keep a full tie
order (measure desc, then key asc) so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import nz
from ..functions.timefmt import epoch_date_str, epoch_dow, epoch_hour, iso_from_epoch, parse_epoch


def _top(df: DataFrame, order, top):
    return df.orderBy(*order).limit(top) if top is not None else df


# -- files ----------------------------------------------------------------------

def agg_file_stats(table: DataFrame) -> DataFrame:
    """Rows and time range per file of a normalised table."""
    return table.groupBy("file_id").agg(F.count(F.lit(1)).alias("rows"), F.min("ts_epoch").alias("start_epoch"),
                                        F.max("ts_epoch").alias("end_epoch"))


def agg_coverage(files: DataFrame) -> DataFrame:
    """Global first / last event time over files with a known range."""
    f = files.filter(F.col("start_epoch").isNotNull() & F.col("end_epoch").isNotNull())
    agg = f.agg(F.min("start_epoch").alias("start_epoch"), F.max("end_epoch").alias("end_epoch"))
    return agg.select("start_epoch", "end_epoch",
                      F.when(F.coalesce("start_epoch", F.lit(0)) != 0, iso_from_epoch("start_epoch"))
                      .otherwise(F.lit("")).alias("start"),
                      F.when(F.coalesce("end_epoch", F.lit(0)) != 0, iso_from_epoch("end_epoch"))
                      .otherwise(F.lit("")).alias("end"))


def agg_family_counts(files: DataFrame) -> DataFrame:
    return (files.groupBy("family").agg(F.sum(F.coalesce("rows", F.lit(0))).cast("long").alias("rows"))
            .orderBy(F.desc("rows"), F.asc("family")))


def list_files(files: DataFrame) -> DataFrame:
    """Inventory rows for the report, ordered by (family, name)."""
    iso = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) != 0, iso_from_epoch(c)).otherwise(F.lit(""))  # noqa
    return files.select(nz("name").alias("name"), nz("family").alias("family"),
                        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), nz("sha256").alias("sha256"),
                        nz("delimiter").alias("delimiter"), F.coalesce("skiprows", F.lit(0)).cast("long")
                        .alias("skiprows"), iso("start_epoch").alias("start"), iso("end_epoch").alias("end"),
                        nz("path").alias("path")).orderBy("family", "name")


def file_ranges(files: DataFrame) -> DataFrame:
    """One row per file with ISO range (``sink_file_ranges`` content), ordered by name."""
    cols = F.to_json(F.col("columns")) if "columns" in files.columns else F.lit("[]")
    return files.select("file_id", nz("name").alias("name"), nz("family").alias("family"),
                        F.col("rows").cast("long").alias("rows"), iso_from_epoch("start_epoch").alias("start"),
                        iso_from_epoch("end_epoch").alias("end"), nz("sha256").alias("sha256"),
                        nz("delimiter").alias("delimiter"), F.col("skiprows").cast("long").alias("skiprows"),
                        cols.alias("columns"), nz("error").alias("error")).orderBy("name")


# -- sign-in / audit ------------------------------------------------------------

def agg_top_fail(signin: DataFrame, key: str = "ip", top: int | None = K.TOP_FAIL) -> DataFrame:
    """Strict failures (timestamped) per ``key``, top ``top`` (``agg_top_fail_ips/users``)."""
    f = signin.filter((nz(key) != "") & F.col("ts_epoch").isNotNull() & P.sql_failure())
    out = f.groupBy(key).agg(F.count(F.lit(1)).alias("fails"))
    return _top(out, [F.desc("fails"), F.asc(key)], top)


def agg_dash_fail(signin: DataFrame, key: str = "ip", other: str = "user",
                  top: int | None = K.TOP_DASH_FAIL) -> DataFrame:
    """Dashboard failures + distinct ``other`` per ``key`` (``agg_dash_fail_ips/users``)."""
    other_name = "users" if other == "user" else "ips"
    f = signin.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    out = f.groupBy(key).agg(F.sum(F.when(P.dashboard_failure(), 1).otherwise(0)).cast("long").alias("fails"),
                             F.countDistinct(other).alias(other_name))
    return _top(out, [F.desc("fails"), F.desc(other_name), F.asc(key)], top)


def agg_by_day(table: DataFrame) -> DataFrame:
    """Events per UTC date (``agg_signin_by_day`` / ``agg_ual_by_day``)."""
    return (table.filter(F.col("ts_epoch").isNotNull())
            .groupBy(epoch_date_str("ts_epoch").alias("date")).agg(F.count(F.lit(1)).alias("count"))
            .orderBy("date"))


def agg_heatmap(signin: DataFrame) -> DataFrame:
    """Sign-ins by day of week (0 = Sunday) x hour, dense 7 x 24 grid with zeros."""
    spark = signin.sparkSession
    counts = (signin.filter(F.col("ts_epoch").isNotNull())
              .groupBy(epoch_dow("ts_epoch").alias("dow"), epoch_hour("ts_epoch").alias("hour"))
              .agg(F.count(F.lit(1)).alias("count")))
    grid = spark.range(7 * 24).select((F.col("id") / 24).cast("long").alias("dow"),
                                      F.pmod(F.col("id"), F.lit(24)).alias("hour"))
    # both sides hold at most 168 rows
    return (F.broadcast(grid).join(F.broadcast(counts), ["dow", "hour"], "left")
            .select("dow", "hour", F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def agg_user_signin_summary(signin: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Per user: successes, failures (SQL flavour) and distinct IPs."""
    s = signin.filter(nz("user") != "")
    if users is not None:
        s = s.join(users.select("user"), "user", "left_semi")
    return s.groupBy("user").agg(
        F.sum(F.when(P.sql_success(), 1).otherwise(0)).cast("long").alias("success"),
        F.sum(F.when(P.sql_failure(), 1).otherwise(0)).cast("long").alias("fail"),
        F.countDistinct("ip").alias("ips"))


def agg_top_case_users(signin: DataFrame, ual: DataFrame, top: int | None = K.CASE_TOP_USERS) -> DataFrame:
    """Users by total audit + sign-in events."""
    a = ual.filter(nz("user") != "").groupBy("user").agg(F.count(F.lit(1)).alias("c"))
    b = signin.filter(nz("user") != "").groupBy("user").agg(F.count(F.lit(1)).alias("c"))
    out = a.unionByName(b).groupBy("user").agg(F.sum("c").cast("long").alias("events"))
    return _top(out, [F.desc("events"), F.asc("user")], top)


# -- findings -------------------------------------------------------------------

def agg_severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy(F.lower("severity").alias("severity")).agg(F.count(F.lit(1)).alias("count"))


def agg_category_counts(findings: DataFrame, top: int | None = None) -> DataFrame:
    out = findings.groupBy("category").agg(F.count(F.lit(1)).alias("count"))
    return _top(out, [F.desc("count"), F.asc("category")], top)


def _score_col(sev_counts_by_name: dict) -> F.Column:
    total = None
    for name, weight in K.RISK_SCORE_WEIGHTS.items():
        term = sev_counts_by_name[name] * F.lit(weight)
        total = term if total is None else total + term
    return F.least(F.lit(K.RISK_SCORE_CAP).cast("long"), total.cast("long"))


def risk_label(score) -> F.Column:
    expr = None
    for thr, label in K.RISK_LABELS:
        expr = F.when(score >= thr, F.lit(label)) if expr is None else expr.when(score >= thr, F.lit(label))
    return expr.otherwise(F.lit(K.RISK_LABEL_DEFAULT))


def agg_risk_score(findings: DataFrame) -> DataFrame:
    """``min(100, 35*critical + 20*high + 8*medium + 2*low)`` and its label."""
    sev = F.lower("severity")
    counts = {n: F.sum(F.when(sev == n, 1).otherwise(0)) for n in K.RISK_SCORE_WEIGHTS}
    score = _score_col(counts)
    return findings.agg(score.alias("risk_score")).select("risk_score", risk_label(F.col("risk_score"))
                                                          .alias("risk_label"))


def agg_kpis(findings: DataFrame, files: DataFrame, signin: DataFrame, ual: DataFrame) -> DataFrame:
    """One-row KPI table.

    Each source is aggregated on its own (the distinct user / IP counts only
    touch findings; the sign-in and audit counts need no columns), then the
    one-row results are merged as (metric, value) rows and pivoted: no join
    and no row expansion over the big tables.
    """
    sev = F.lower(nz("severity"))
    counts = {n: F.sum(F.when(sev == n, 1).otherwise(0)) for n in K.RISK_SCORE_WEIGHTS}
    f = findings.agg(_score_col(counts).alias("risk_score"), F.count(F.lit(1)).alias("total_findings"),
                     F.countDistinct(F.when(nz("user") != "", F.col("user"))).alias("impacted_users"),
                     F.countDistinct(F.when(nz("ip") != "", F.col("ip"))).alias("impacted_ips"))
    # the findings are read once: their one row becomes (metric, value) rows
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in f.columns]))
    parts = [f.select(pairs)]
    for name, df in (("total_files", files), ("signin_rows", signin), ("ual_rows", ual)):
        parts.append(df.agg(F.count(F.lit(1)).alias("value")).select(F.lit(name).alias("metric"), "value"))
    long = parts[0]
    for p_ in parts[1:]:
        long = long.unionByName(p_)
    order = ["risk_score", "total_files", "total_findings", "impacted_users", "impacted_ips", "signin_rows",
             "ual_rows"]
    wide = long.groupBy().pivot("metric", order).agg(F.first("value"))
    return wide.select(*[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in order])


def agg_impacted(findings: DataFrame, col: str = "user", top: int | None = None) -> DataFrame:
    """Sorted distinct non-empty users / IPs of findings (``agg_impacted_users/ips``)."""
    out = findings.filter(nz(col) != "").select(col).distinct()
    return _top(out, [F.asc(col)], top)


def agg_impacted_countries(findings: DataFrame, top: int | None = None) -> DataFrame:
    out = findings.filter(nz("country") != "").groupBy("country").agg(F.count(F.lit(1)).alias("count"))
    return _top(out, [F.desc("count"), F.asc("country")], top)


def agg_findings_by_day(findings: DataFrame) -> DataFrame:
    """Findings per UTC date of their timestamp; unparseable timestamps are dropped."""
    e = parse_epoch(F.col("timestamp"))
    return (findings.filter(nz("timestamp") != "").select(e.alias("_e")).filter(F.col("_e").isNotNull())
            .groupBy(epoch_date_str("_e").alias("date")).agg(F.count(F.lit(1)).alias("count")).orderBy("date"))


def join_daily_series(signin_by_day: DataFrame, ual_by_day: DataFrame, findings_by_day: DataFrame,
                      last_days: int | None = K.DAILY_LAST_DAYS) -> DataFrame:
    """Full merge by date of three daily series, missing -> 0, last ``last_days`` dates."""
    u = (signin_by_day.select("date", F.col("count").alias("signin"), F.lit(0).cast("long").alias("ual"),
                              F.lit(0).cast("long").alias("findings"))
         .unionByName(ual_by_day.select("date", F.lit(0).cast("long").alias("signin"), F.col("count").alias("ual"),
                                        F.lit(0).cast("long").alias("findings")))
         .unionByName(findings_by_day.select("date", F.lit(0).cast("long").alias("signin"),
                                             F.lit(0).cast("long").alias("ual"), F.col("count").alias("findings"))))
    out = u.groupBy("date").agg(F.sum("signin").cast("long").alias("signin"), F.sum("ual").cast("long").alias("ual"),
                                F.sum("findings").cast("long").alias("findings"))
    out = out.withColumn("total", F.col("signin") + F.col("ual"))
    if last_days is not None:
        out = out.orderBy(F.desc("date")).limit(last_days)
    return out.orderBy("date")
