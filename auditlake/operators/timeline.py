"""Event timelines and per-user case views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import concat_str, file_safe_key, nz, opt_part, ref
from ..schema import TIMELINE_COLUMNS


def ual_suspicious_flag(ual: DataFrame) -> F.Column:
    ad_l = F.lower(nz("auditdata"))
    return ((P.ual_severity() != "") | P.forwarding(ad_l) | P.inbox_keywords(ad_l)
            | F.lower(nz("operation")).contains("mailitemsaccessed"))


def timeline_ual(ual: DataFrame, quick: bool = False) -> DataFrame:
    rows = ual.filter(F.col("ts_epoch").isNotNull())
    if quick:
        rows = rows.filter(ual_suspicious_flag(rows))
    return rows.select(nz("ts_iso").alias("ts"), F.col("ts_epoch").alias("epoch"), F.lit("ual").alias("source"),
                       nz("user").alias("user"), nz("ip").alias("ip"), nz("operation").alias("action"),
                       nz("workload").alias("detail"), ref("file_id", "rownum").alias("ref"))


def timeline_signin(signin: DataFrame) -> DataFrame:
    rows = signin.filter(F.col("ts_epoch").isNotNull())
    detail = concat_str("app=", nz("app"), " client=", nz("client_app"), " status=", nz("status"), " result=",
                        nz("result_type"),
                        opt_part(nz("error_code") != "", " error_code=", nz("error_code")),
                        opt_part(nz("failure_reason") != "", " reason=", nz("failure_reason")),
                        opt_part(nz("country") != "", " country=", nz("country")))
    return rows.select(nz("ts_iso").alias("ts"), F.col("ts_epoch").alias("epoch"), F.lit("signin").alias("source"),
                       nz("user").alias("user"), nz("ip").alias("ip"), P.signin_action().alias("action"),
                       detail.alias("detail"), ref("file_id", "rownum").alias("ref"))


def union_timeline(signin: DataFrame, ual: DataFrame, mode: str = "deep", sort: bool = True,
                   max_ual_rows: int | None = None, max_signin_rows: int | None = None) -> DataFrame:
    """Sign-in and audit events as one timeline ordered by (epoch, source).

    ``mode='quick'`` keeps only suspicious audit rows and no sign-ins.  The
    optional row caps keep the earliest rows of each source (off by default).
    """
    quick = mode == "quick"
    u = timeline_ual(ual, quick)
    if max_ual_rows is not None:
        u = u.orderBy("epoch", "ref").limit(max_ual_rows)
    out = u
    if not quick:
        s = timeline_signin(signin)
        if max_signin_rows is not None:
            s = s.orderBy("epoch", "ref").limit(max_signin_rows)
        out = out.unionByName(s)
    if sort:
        out = out.orderBy(F.coalesce("epoch", F.lit(0)), "source", "ref")
    return out.select(*TIMELINE_COLUMNS)


CASE_COLUMNS = ["user", "ts", "src", "ip", "action", "detail", "ref"]


def case_events(signin: DataFrame, ual: DataFrame) -> DataFrame:
    """Per-user sign-in and audit events with uniform columns (``union_case_timeline``)."""
    s = signin.filter((nz("user") != "") & F.col("ts_epoch").isNotNull())
    s_detail = concat_str("app=", nz("app"), " client=", nz("client_app"), " status=", nz("status"), " result=",
                          nz("result_type"), opt_part(nz("error_code") != "", " ec=", nz("error_code")),
                          opt_part(nz("failure_reason") != "", " fr=", nz("failure_reason")))
    s = s.select("user", "ts_epoch", F.lit(0).alias("_src"), "file_id", "rownum", nz("ts_iso").alias("ts"),
                 F.lit("signin").alias("src"), nz("ip").alias("ip"), F.lit("signin").alias("action"),
                 s_detail.alias("detail"), ref("file_id", "rownum").alias("ref"))
    u = ual.filter((nz("user") != "") & F.col("ts_epoch").isNotNull())
    u = u.select("user", "ts_epoch", F.lit(1).alias("_src"), "file_id", "rownum", nz("ts_iso").alias("ts"),
                 F.lit("ual").alias("src"), nz("ip").alias("ip"), F.lit("ual").alias("action"),
                 concat_str("op=", nz("operation"), " workload=", nz("workload")).alias("detail"),
                 ref("file_id", "rownum").alias("ref"))
    return s.unionByName(u)


def last_n_user_events(signin: DataFrame, ual: DataFrame, n: int = K.CASE_LAST_EVENTS,
                       users: DataFrame | None = None) -> DataFrame:
    """Each user's last ``n`` events (``win_last_n_user_events``), with the case file key.

    ``row_number() <= n`` lets Spark keep a per-partition top-n before the
    shuffle, so a hot user ships at most ``n`` rows per input partition.
    """
    ev = case_events(signin, ual)
    if users is not None:
        ev = ev.join(users.select("user"), "user", "left_semi")
    w = Window.partitionBy("user").orderBy(F.desc("ts_epoch"), F.desc("_src"), F.desc("file_id"), F.desc("rownum"))
    return (ev.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
            .withColumn("user_key", file_safe_key("user"))
            .select(*CASE_COLUMNS, "user_key", "ts_epoch", "_src", "file_id", "rownum"))
