"""Row-level detectors: one filter + projection each, no shuffle.

``det_risky_signin``, ``det_legacy_auth``, ``det_ual_suspicious``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.jsonfn import dangerous_scopes, oauth_scopes, scope_json_text
from ..functions.text import concat_str, nz, opt_part, py_bool, py_list
from ..schema import exploded_findings, finding_columns
from .lookup import with_file_sha


def _row_id(prefix: str):
    return concat_str(prefix, F.col("file_id").cast("string"), "-", F.col("rownum").cast("string"))


def risky_columns() -> list[Column]:
    cat, title = K.FINDING_META["risky_signin"]
    details = concat_str("risk_level=", nz("risk_level"), " risk_state=", nz("risk_state"),
                         " risk_detail=", nz("risk_detail"), " app=", nz("app"), " client=", nz("client_app"))
    evidence = F.struct(nz("risk_level").alias("risk_level"), nz("risk_state").alias("risk_state"),
                        nz("risk_detail").alias("risk_detail"), nz("app").alias("app"),
                        nz("client_app").alias("client_app"))
    return finding_columns(finding_id=_row_id("RISKY-SIGNIN-"), severity=P.risk_severity(), category=cat,
                          title=title, timestamp=F.col("ts_iso"), user=F.col("user"), ip=F.col("ip"),
                          country=F.col("country"), file=F.col("file_id").cast("string"),
                          rownum=F.col("rownum").cast("string"), sha256=F.col("sha256"), details=details,
                          evidence=evidence)


def legacy_columns(ok: Column) -> list[Column]:
    cat, title = K.FINDING_META["legacy_auth"]
    details = concat_str(
        "legacy_client='", nz("client_app"), "' app='", nz("app"), "' success=", py_bool(ok),
        opt_part(nz("error_code") != "", " error_code=", nz("error_code")),
        opt_part(nz("failure_reason") != "", " reason=", nz("failure_reason")))
    evidence = F.struct(nz("app").alias("app"), nz("client_app").alias("client_app"),
                        nz("status").alias("status"), nz("result_type").alias("result_type"))
    return finding_columns(finding_id=_row_id("LEGACY-AUTH-"),
                          severity=F.when(ok, F.lit("high")).otherwise(F.lit("medium")),
                          category=cat, title=title, timestamp=F.col("ts_iso"), user=F.col("user"),
                          ip=F.col("ip"), country=F.col("country"), file=F.col("file_id").cast("string"),
                          rownum=F.col("rownum").cast("string"), sha256=F.col("sha256"), details=details,
                          evidence=evidence)


def det_risky_signin(signin: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Sign-ins whose risk fields are set and not all benign."""
    rows = with_file_sha(signin.filter(P.risk_flagged()), files)
    return rows.select(*risky_columns())


def det_legacy_auth(signin: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Legacy protocol sign-ins; high when the sign-in succeeded."""
    rows = with_file_sha(signin.filter(P.legacy_client()).withColumn("_ok", P.signin_success()), files)
    return rows.select(*legacy_columns(F.col("_ok")))


def ual_suspicious_rows(ual: DataFrame, keep_all: bool = False) -> DataFrame:
    """Classified audit rows with the boost signals (shared by detector, fused pass and stream twin).

    The cheap operation test runs first; AuditData is only scanned for the
    rows that pass it (``_susp``).  ``keep_all`` keeps the other rows too
    (for the fused pass that also evaluates rules), with the signals unset.
    """
    base = ual.withColumn("_sev0", P.ual_severity()).withColumn("_susp", (F.col("_sev0") != "") | P.ual_hint())
    if not keep_all:
        base = base.filter("_susp")
    ad_l = F.lower(nz("auditdata"))
    susp = F.col("_susp")
    rows = (base
            .withColumn("_fwd", susp & P.forwarding(ad_l))
            .withColumn("_inbox", susp & P.inbox_rule(ad_l))
            .withColumn("_jtxt", F.when(susp, scope_json_text("auditdata")))
            .withColumn("_scopes", oauth_scopes(json_text="_jtxt"))
            .withColumn("_danger", dangerous_scopes(F.col("_scopes"))))
    sev = (F.when(F.size("_danger") > 0, F.lit("high"))
           .when(F.col("_fwd"), F.lit("high"))
           .when(F.col("_sev0") != "", F.col("_sev0"))
           .otherwise(F.lit("medium")))
    return rows.withColumn("_sev", sev)


def ual_columns() -> list[Column]:
    cat, title = K.FINDING_META["ual_suspicious"]
    details = concat_str(
        "operation=", nz("operation"), " workload=", nz("workload"), " record_type=", nz("record_type"),
        opt_part(F.col("_fwd"), " forwarding_indicator=true"),
        opt_part(F.col("_inbox"), " inbox_rule_indicator=true"),
        opt_part(F.size("_danger") > 0, " dangerous_scopes=", py_list("_danger")))
    evidence = F.struct(nz("operation").alias("operation"), nz("workload").alias("workload"),
                        nz("record_type").alias("record_type"), nz("object_id").alias("object_id"),
                        F.col("_fwd").alias("forwarding"), F.col("_inbox").alias("inboxrule"),
                        F.col("_scopes").alias("scopes"))
    return finding_columns(finding_id=_row_id("UAL-"), severity=F.col("_sev"), category=cat, title=title,
                          timestamp=F.col("ts_iso"), user=F.col("user"), ip=F.col("ip"), country="",
                          file=F.col("file_id").cast("string"), rownum=F.col("rownum").cast("string"),
                          sha256=F.col("sha256"), details=details, evidence=evidence)


def det_ual_suspicious(ual: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Suspicious audit operations, boosted by forwarding or dangerous OAuth scopes."""
    rows = with_file_sha(ual_suspicious_rows(ual), files)
    return rows.select(*ual_columns())


def fused_signin_findings(signin: DataFrame, files: DataFrame | None = None, rules=None) -> DataFrame:
    """Risky sign-ins (1), legacy auth (2) and sign-in rules (10) in one pass over ``signin``."""
    from .rules import indexed_findings, rule_items, split_rules, validate_rules, SIGNIN_TEXT
    rows = with_file_sha(signin, files).withColumn("_ok", P.signin_success())
    items = [(1, P.risk_flagged(), risky_columns()), (2, P.legacy_client(), legacy_columns(F.col("_ok")))]
    rs, looked_up = split_rules([r for r in validate_rules(rules) if r.family == "signin"] if rules else [])
    if rs:
        rows, extra = rule_items(rows, rs, SIGNIN_TEXT, ["app", "client_app"], 10)
        items += extra
    found = exploded_findings(rows, items)
    return found.unionByName(indexed_findings(signin, looked_up, SIGNIN_TEXT, ["app", "client_app"], files).withColumn(
        "detector_no", F.lit(10))) if looked_up else found


def fused_ual_findings(ual: DataFrame, files: DataFrame | None = None, rules=None) -> DataFrame:
    """Suspicious audit operations (7) and audit rules (10) in one pass over ``ual``."""
    from .rules import indexed_findings, rule_items, split_rules, validate_rules, UAL_TEXT
    rs, looked_up = split_rules([r for r in validate_rules(rules) if r.family == "ual"] if rules else [])
    rows = with_file_sha(ual_suspicious_rows(ual, keep_all=bool(rs)), files)
    items = [(7, F.col("_susp"), ual_columns())]
    if rs:
        rows, extra = rule_items(rows, rs, UAL_TEXT, ["operation"], 10)
        items += extra
    found = exploded_findings(rows, items)
    return found.unionByName(indexed_findings(ual, looked_up, UAL_TEXT, ["operation"], files).withColumn("detector_no", F.lit(10))) \
        if looked_up else found
