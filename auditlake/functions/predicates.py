"""Predicate Column builders shared by detectors, pivots and timelines.

Each takes canonical column names (or Columns) and returns a boolean or a
severity Column.  No Python UDFs: everything stays inside codegen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K
from .text import col_, contains_any, nz, strip_ws


def _rt(result_type="result_type") -> Column:
    return strip_ws(nz(result_type))


# -- sign-in outcome, "all digits" flavour (row detectors, sequences) --------

def signin_success(result_type="result_type", status="status") -> Column:
    """All-digit trimmed result type decides alone (== 0); else status says success."""
    rt = _rt(result_type)
    return F.when(rt.rlike(r"^[0-9]+$"), rt.rlike(r"^0+$")).otherwise(
        F.lower(nz(status)).contains(K.SUCCESS_STATUS_WORD))


def signin_failure(result_type="result_type", status="status") -> Column:
    rt = _rt(result_type)
    return F.when(rt.rlike(r"^[0-9]+$"), ~rt.rlike(r"^0+$")).otherwise(
        F.lower(nz(status)).rlike(K.FAILURE_STATUS_PATTERN))


def signin_action(result_type="result_type", status="status") -> Column:
    return (F.when(signin_failure(result_type, status), F.lit("signin_failure"))
            .when(signin_success(result_type, status), F.lit("signin_success"))
            .otherwise(F.lit("signin_event")))


# -- "starts with a digit" flavour (campaign / pivot SQL) ---------------------

def _leading_int_nonzero(rt: Column) -> Column:
    # leading integer of the text is non-zero  <=>  ^0*[1-9]
    return rt.rlike(r"^0*[1-9]")


def sql_failure(result_type="result_type", status="status") -> Column:
    rt = nz(result_type)
    st = F.lower(nz(status))
    return F.when(rt.rlike(r"^[0-9]"), _leading_int_nonzero(rt)).otherwise(
        contains_any(st, K.SQL_FAILURE_STATUS_WORDS))


def sql_success(result_type="result_type", status="status") -> Column:
    rt = nz(result_type)
    return F.when(rt.rlike(r"^[0-9]"), ~_leading_int_nonzero(rt)).otherwise(
        F.lower(nz(status)).contains(K.SUCCESS_STATUS_WORD))


def dashboard_failure(result_type="result_type", status="status") -> Column:
    """Dashboard flavour: any result type other than '0' (empty included) or fail/error status."""
    return (nz(result_type) != "0") | contains_any(F.lower(nz(status)), K.DASHBOARD_FAILURE_STATUS_WORDS)


# -- risk / legacy -------------------------------------------------------------

def _norm(c) -> Column:
    return F.lower(strip_ws(nz(c)))


def risk_flagged(level="risk_level", state="risk_state", detail="risk_detail") -> Column:
    rl, rs, rd = _norm(level), _norm(state), _norm(detail)
    all_empty = (rl == "") & (rs == "") & (rd == "")
    benign = rl.isin(K.BENIGN_RISK_LEVELS) & rs.isin(K.BENIGN_RISK_STATES) & rd.isin(K.BENIGN_RISK_DETAILS)
    return ~all_empty & ~benign


def risk_severity(level="risk_level", state="risk_state") -> Column:
    rl, rs = _norm(level), _norm(state)
    return F.when(rl.isin(K.HIGH_RISK_LEVELS) | rs.contains(K.AT_RISK_STATE_WORD), F.lit("high")).otherwise(
        F.lit("medium"))


def legacy_client(app="app", client_app="client_app") -> Column:
    txt = F.lower(F.concat_ws(" ", nz(app), nz(client_app)))
    return contains_any(txt, K.LEGACY_CLIENT_PATTERNS)


def risky_prior_signin(level="risk_level", state="risk_state", detail="risk_detail") -> Column:
    """Any risk field set and not none/low (correlation escalation)."""
    tests = [(F.lower(nz(c)) != "") & ~F.lower(nz(c)).isin(K.CORRELATION_BENIGN_RISK) for c in (level, state, detail)]
    return reduce(lambda a, b: a | b, tests)


# -- audit log -------------------------------------------------------------------

_REGEX_META = set(".^$*+?{}[]\\|()")


def search_any(c: Column, patterns) -> Column:
    """Regex search for any pattern; literal patterns become substring tests (same result, no backtracking)."""
    if all(not (set(p) & _REGEX_META) for p in patterns):
        return contains_any(c, patterns)
    return c.rlike("|".join(patterns))


def ual_severity(operation="operation") -> Column:
    """'high' / 'medium' / '' by ordered pattern lists over the lower-cased operation."""
    op = F.lower(nz(operation))
    return (F.when(search_any(op, K.UAL_HIGH_PATTERNS), F.lit("high"))
            .when(search_any(op, K.UAL_MEDIUM_PATTERNS), F.lit("medium"))
            .otherwise(F.lit("")))


def ual_hint(operation="operation") -> Column:
    return contains_any(F.lower(nz(operation)), K.UAL_HINT_WORDS)


def forwarding(auditdata_lower: Column) -> Column:
    """AuditData (already lower-cased) carries a forwarding keyword."""
    return contains_any(auditdata_lower, K.FORWARDING_KEYWORDS)


def inbox_keywords(auditdata_lower: Column) -> Column:
    return contains_any(auditdata_lower, K.INBOX_RULE_KEYWORDS)


def inbox_rule(auditdata_lower: Column, operation="operation") -> Column:
    return inbox_keywords(auditdata_lower) | F.lower(nz(operation)).contains("inboxrule")


def mail_access_context(operation="operation", auditdata="auditdata") -> Column:
    op = F.lower(nz(operation))
    ad = F.lower(nz(auditdata))
    return contains_any(op, K.SPIKE_CONTEXT_OPERATION_WORDS) | contains_any(ad, K.SPIKE_CONTEXT_AUDITDATA_WORDS)


def mail_access(operation="operation", auditdata="auditdata") -> Column:
    op = F.lower(nz(operation))
    ad = F.lower(nz(auditdata))
    return contains_any(op, K.SPIKE_ACCESS_OPERATION_WORDS) | contains_any(ad, K.SPIKE_ACCESS_AUDITDATA_WORDS)


def error_code(result_type="result_type") -> Column:
    """First 3-6 digit run of the trimmed result type ('' when none)."""
    return F.regexp_extract(strip_ws(nz(result_type)), K.ERROR_CODE_PATTERN, 1)


def error_hint(code) -> Column:
    """Hint text for a handful of well-known error codes (NULL when unknown)."""
    pairs = []
    for k, v in K.AADSTS_HINTS.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.element_at(F.create_map(*pairs), nz(code)) if pairs else F.lit(None)


def severity_rank(severity, ranks: dict) -> Column:
    s = F.lower(nz(severity))
    expr = None
    for k, v in ranks.items():
        expr = F.when(s == k, F.lit(v)) if expr is None else expr.when(s == k, F.lit(v))
    return expr.otherwise(F.lit(K.SEVERITY_RANK_DEFAULT))
