"""As-of correlation of sensitive audit actions to the prior successful sign-in.

For every driver audit row: of the user's ``last_n`` newest sign-ins at or
before the audit time, take the newest successful one; keep the pair when it
is at most ``max_minutes`` old.

Plan (no join, no per-row probe): sign-ins and audit rows of a user are
unioned and ordered by (ts, source, file, row).  A bounded window over the
sign-ins gives, per sign-in, the newest success among itself and its
``last_n - 1`` predecessors; a running ``last(..., ignorenulls)`` hands the
value of the latest sign-in to each following audit row.  Partitioning is by
(user, time chunk) with the last ``max_minutes`` of sign-ins of the previous
chunk copied in as a halo, which is exact because a partner older than the
window can never produce a finding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import concat_str, nz, ref
from ..schema import finding
from .lookup import with_file_sha
from .sequence import DEFAULT_CHUNK_SECONDS, chunk_of, with_halo


def correlation_drivers(ual: DataFrame) -> DataFrame:
    """Audit rows that start a correlation, with their base severity."""
    ad_l = F.lower(nz("auditdata"))
    sev0 = P.ual_severity()
    kw = P.forwarding(ad_l) | P.inbox_keywords(ad_l)
    return (ual.filter(F.col("ts_epoch").isNotNull() & (nz("user") != ""))
            .withColumn("_sev0", sev0)
            .filter((F.col("_sev0") != "") | kw)
            .withColumn("_base", F.when(F.col("_sev0") != "", F.col("_sev0")).otherwise(F.lit("high"))))


def asof_pairs(signin: DataFrame, drivers: DataFrame, max_minutes: int = 60, last_n: int = 5,
               chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """``drivers`` rows with ``_best`` (struct of the matched sign-in) and ``_dt`` seconds."""
    W = int(max_minutes) * 60
    L = max(int(chunk_seconds), W)
    payload = F.struct(F.col("ts_epoch").alias("ts"), nz("ts_iso").alias("ts_iso"), nz("ip").alias("ip"),
                       nz("country").alias("country"), nz("app").alias("app"),
                       nz("client_app").alias("client_app"), nz("risk_level").alias("risk_level"),
                       nz("risk_state").alias("risk_state"), nz("risk_detail").alias("risk_detail"))
    s = (signin.filter(F.col("ts_epoch").isNotNull() & (nz("user") != ""))
         .select("user", "ts_epoch", "file_id", "rownum", P.signin_success().alias("_ok"), payload.alias("_p")))
    s = with_halo(s, "ts_epoch", L, W)
    w_last = (Window.partitionBy("user", "_chunk").orderBy("ts_epoch", "file_id", "rownum")
              .rowsBetween(-(int(last_n) - 1), 0))
    s = s.withColumn("_best", F.last(F.when(F.col("_ok"), F.col("_p")), ignorenulls=True).over(w_last))
    s_side = s.select("user", "_chunk", "ts_epoch", F.lit(0).alias("_src"), "file_id", "rownum",
                      F.struct(F.col("_best").alias("b")).alias("_carry"))
    d_cols = [c for c in drivers.columns if c not in ("user", "ts_epoch", "file_id", "rownum")]
    d = drivers.withColumn("_chunk", chunk_of("ts_epoch", L))
    d_side = d.select("user", "_chunk", "ts_epoch", F.lit(1).alias("_src"), "file_id", "rownum",
                      F.struct(*d_cols).alias("_d"))
    both = s_side.unionByName(d_side, allowMissingColumns=True)
    w_run = (Window.partitionBy("user", "_chunk").orderBy("ts_epoch", "_src", "file_id", "rownum")
             .rowsBetween(Window.unboundedPreceding, 0))
    res = (both.withColumn("_c", F.last("_carry", ignorenulls=True).over(w_run))
           .filter(F.col("_src") == 1)
           .withColumn("_best", F.col("_c.b"))
           .filter(F.col("_best").isNotNull())
           .withColumn("_dt", F.col("ts_epoch") - F.col("_best.ts"))
           .filter((F.col("_dt") >= 0) & (F.col("_dt") <= W)))
    return res.select("user", "ts_epoch", "file_id", "rownum", "_d.*", "_best", "_dt")


def det_correlation(signin: DataFrame, ual: DataFrame, files: DataFrame | None = None, max_minutes: int = 60,
                    last_n: int = 5, chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    cat, title = K.FINDING_META["correlation"]
    pairs = asof_pairs(signin, correlation_drivers(ual), max_minutes, last_n, chunk_seconds)
    b = lambda f: F.col(f"_best.{f}")
    risky = P.risky_prior_signin(b("risk_level"), b("risk_state"), b("risk_detail"))
    legacy = P.legacy_client(b("client_app"), b("app"))
    mismatch = (b("ip") != "") & (nz("ip") != "") & (b("ip") != nz("ip"))
    pairs = (pairs.withColumn("_risky", risky).withColumn("_legacy", legacy).withColumn("_mism", mismatch))
    sev = F.when(F.col("_risky") | F.col("_legacy") | (F.col("_base") == "high"), F.lit("high")).otherwise(
        F.lit("medium"))
    notes = F.filter(F.array(
        F.when(F.col("_risky"), F.lit("prior_signin_risky=true")),
        F.when(F.col("_legacy"), F.lit("prior_signin_legacy=true")),
        F.when(F.col("_mism"), F.lit("ip_mismatch=true"))), lambda x: x.isNotNull())
    pairs = with_file_sha(pairs.withColumn("_notes", notes), files)
    details = concat_str("UAL op '", nz("operation"), "' within ", F.expr("_dt div 60").cast("string"),
                         "m of successful sign-in (client=", b("client_app"), "). ", F.array_join("_notes", " "))
    evidence = F.struct(
        F.struct(nz("operation").alias("operation"), nz("workload").alias("workload"), nz("ip").alias("ip"),
                 ref("file_id", "rownum").alias("ref")).alias("ual"),
        F.struct(b("ts_iso").alias("ts"), b("ip").alias("ip"), b("country").alias("country"), b("app").alias("app"),
                 b("client_app").alias("client"), b("risk_level").alias("risk_level"),
                 b("risk_state").alias("risk_state"), b("risk_detail").alias("risk_detail")).alias("signin"),
        F.col("_dt").alias("delta_seconds"), F.col("_notes").alias("notes"))
    fid = concat_str("CORR-UAL-SIGNIN-", F.col("file_id").cast("string"), "-", F.col("rownum").cast("string"))
    return finding(pairs, finding_id=fid, severity=sev, category=cat, title=title, timestamp=nz("ts_iso"),
                   user=F.col("user"), ip=nz("ip"), country="", file=F.col("file_id").cast("string"),
                   rownum=F.col("rownum").cast("string"), sha256=F.col("sha256"), details=details,
                   evidence=evidence)


def correlation_pairs_all(signin: DataFrame, ual: DataFrame, max_minutes: int = 60, last_n: int = 5,
                          chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Pairing only, for every timestamped audit row with a user (``join_asof_ual_signin``)."""
    drivers = ual.filter(F.col("ts_epoch").isNotNull() & (nz("user") != ""))
    p = asof_pairs(signin, drivers.select("user", "ts_epoch", "file_id", "rownum", "operation"),
                   max_minutes, last_n, chunk_seconds)
    return p.select(F.col("file_id").alias("ual_file_id"), F.col("rownum").alias("ual_rownum"), "user",
                    F.col("ts_epoch").alias("ual_ts"), F.col("_best.ts").alias("signin_ts"),
                    F.col("_best.ip").alias("signin_ip"), F.col("_dt").alias("delta_seconds"))

