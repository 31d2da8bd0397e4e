"""Aggregating detectors: epoch-aligned tumbling buckets + HAVING.

``det_password_spray`` (ip x bucket), ``det_bruteforce`` (user x bucket),
``det_mailitems_spike`` (user x bucket).  Each is one partial/final
aggregation; the exact distinct count is planned by Spark as a two-level
aggregation keyed first on (key, bucket, distinct value), so a hot key is
spread over many tasks before the final merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import concat_str, nz
from ..functions.timefmt import iso_from_epoch
from ..schema import finding


def failure_rows(signin: DataFrame) -> DataFrame:
    """Strict failures usable by the campaign detectors."""
    return signin.filter(
        F.col("ts_epoch").isNotNull() & (nz("ip") != "") & (nz("user") != "")
        & ((nz("result_type") != "") | (nz("status") != "")) & P.sql_failure())


def _campaign(signin: DataFrame, key: str, other: str, window_minutes: int, min_failures: int,
              min_other: int, top: int | None) -> DataFrame:
    win = int(window_minutes) * 60
    agg = (failure_rows(signin)
           .groupBy(F.col(key), F.expr(f"ts_epoch div {win}").alias("bucket"))
           .agg(F.count(F.lit(1)).alias("fails"), F.countDistinct(other).alias("n_other"),
                F.min("ts_epoch").alias("min_ts"), F.max("ts_epoch").alias("max_ts"))
           .filter((F.col("fails") >= min_failures) & (F.col("n_other") >= min_other)))
    if top is not None:
        agg = agg.orderBy(F.desc("fails"), F.desc("n_other"), F.asc(key), F.asc("bucket")).limit(top)
    return agg


def campaign_spray(signin: DataFrame, window_minutes: int = 15, min_failures: int = 20, min_users: int = 5,
                   top: int | None = None) -> DataFrame:
    """(ip, bucket, fails, n_other=distinct users, min_ts, max_ts)."""
    return _campaign(signin, "ip", "user", window_minutes, min_failures, min_users, top)


def campaign_brute(signin: DataFrame, window_minutes: int = 15, min_failures: int = 25, min_ips: int = 5,
                   top: int | None = None) -> DataFrame:
    return _campaign(signin, "user", "ip", window_minutes, min_failures, min_ips, top)


def _ts_or_blank(c):
    return F.when(F.coalesce(F.col(c), F.lit(0)) != 0, iso_from_epoch(c)).otherwise(F.lit(""))


def det_password_spray(signin: DataFrame, window_minutes: int = 15, min_failures: int = 20, min_users: int = 5,
                       top: int | None = None) -> DataFrame:
    """One IP failing against many users inside one bucket."""
    cat, title = K.FINDING_META["password_spray"]
    agg = campaign_spray(signin, window_minutes, min_failures, min_users, top)
    start, end = iso_from_epoch("min_ts"), iso_from_epoch("max_ts")
    details = concat_str("failures=", F.col("fails").cast("string"), " distinct_users=",
                         F.col("n_other").cast("string"), f" window={window_minutes}m start=", start, " end=", end)
    evidence = F.struct(F.col("ip"), F.col("fails").alias("failures"), F.col("n_other").alias("distinct_users"),
                        F.lit(window_minutes).alias("window_minutes"), start.alias("start"), end.alias("end"))
    return finding(agg, finding_id=concat_str("SPRAY-", nz("ip"), "-", F.col("bucket").cast("string")),
                   severity="high", category=cat, title=title, timestamp=_ts_or_blank("min_ts"),
                   ip=F.col("ip"), details=details, evidence=evidence)


def det_bruteforce(signin: DataFrame, window_minutes: int = 15, min_failures: int = 25, min_ips: int = 5,
                   top: int | None = None) -> DataFrame:
    """One user failing from many IPs inside one bucket."""
    cat, title = K.FINDING_META["bruteforce"]
    agg = campaign_brute(signin, window_minutes, min_failures, min_ips, top)
    start, end = iso_from_epoch("min_ts"), iso_from_epoch("max_ts")
    details = concat_str("failures=", F.col("fails").cast("string"), " distinct_ips=",
                         F.col("n_other").cast("string"), f" window={window_minutes}m start=", start, " end=", end)
    evidence = F.struct(F.col("user"), F.col("fails").alias("failures"), F.col("n_other").alias("distinct_ips"),
                        F.lit(window_minutes).alias("window_minutes"), start.alias("start"), end.alias("end"))
    return finding(agg, finding_id=concat_str("BRUTE-", nz("user"), "-", F.col("bucket").cast("string")),
                   severity="medium", category=cat, title=title, timestamp=_ts_or_blank("min_ts"),
                   user=F.col("user"), details=details, evidence=evidence)


def mail_access_rows(ual: DataFrame, require_context: bool = False) -> DataFrame:
    cond = F.col("ts_epoch").isNotNull() & (nz("user") != "") & P.mail_access()
    if require_context:
        cond = cond & P.mail_access_context()
    return ual.filter(cond)


def det_mailitems_spike(ual: DataFrame, window_minutes: int = 60, threshold: int = 500,
                        require_context: bool = False, top: int | None = None) -> DataFrame:
    """Mail-access events per (user, bucket) at or above ``threshold``.

    ``require_context=True`` keeps the reference condition (mail access AND a
    mailbox/forwarding context word); ``False`` counts every mail access.
    """
    cat, title = K.FINDING_META["mailitems_spike"]
    win = int(window_minutes) * 60
    agg = (mail_access_rows(ual, require_context)
           .groupBy("user", F.expr(f"ts_epoch div {win}").alias("bucket"))
           .agg(F.count(F.lit(1)).alias("cnt"), F.min("ts_epoch").alias("min_ts"), F.max("ts_epoch").alias("max_ts"))
           .filter(F.col("cnt") >= threshold))
    if top is not None:
        agg = agg.orderBy(F.desc("cnt"), F.asc("user"), F.asc("bucket")).limit(top)
    start, end = iso_from_epoch("min_ts"), iso_from_epoch("max_ts")
    details = concat_str("count=", F.col("cnt").cast("string"), f" in {window_minutes}m window start=", start,
                         " end=", end)
    evidence = F.struct(F.col("user"), F.col("cnt").alias("count"), F.lit(window_minutes).alias("window_minutes"),
                        start.alias("start"), end.alias("end"))
    return finding(agg, finding_id=concat_str("MAILSPIKE-", nz("user"), "-", F.col("bucket").cast("string")),
                   severity="high", category=cat, title=title, timestamp=_ts_or_blank("min_ts"),
                   user=F.col("user"), details=details, evidence=evidence)
