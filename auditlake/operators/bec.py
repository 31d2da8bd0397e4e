"""Business e-mail compromise checklist over the audit table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import nz, ref

EVENT_COLUMNS = ["ts", "user", "ip", "operation", "ref"]


def bec_candidates(ual: DataFrame) -> DataFrame:
    """Rows whose AuditData mentions ``forward`` or whose operation/AuditData mentions ``inboxrule``."""
    ad_l = F.lower(nz("auditdata"))
    op_l = F.lower(nz("operation"))
    return ual.filter(ad_l.contains("forward") | op_l.contains("inboxrule") | ad_l.contains("inboxrule"))


def bec_flagged(ual: DataFrame, prefilter: bool = False) -> DataFrame:
    """Audit rows with the three BEC flags; ``prefilter=True`` drops rows that mention neither forwarding nor inbox rules,
    pure delegation ones among them."""
    base = bec_candidates(ual) if prefilter else ual
    ad_l = F.lower(nz("auditdata"))
    op_l = F.lower(nz("operation"))
    return (base
            .withColumn("_fwd", P.forwarding(ad_l))
            .withColumn("_inbox", op_l.contains("inbox") | P.inbox_keywords(ad_l))
            .withColumn("_deleg", op_l.rlike(K.BEC_DELEGATION_PATTERN)))


def _events(df: DataFrame) -> DataFrame:
    return df.select(nz("ts_iso").alias("ts"), nz("user").alias("user"), nz("ip").alias("ip"),
                     nz("operation").alias("operation"), ref("file_id", "rownum").alias("ref"),
                     "file_id", "rownum")


def bec_forwarding_events(ual: DataFrame, prefilter: bool = False) -> DataFrame:
    return _events(bec_flagged(ual, prefilter).filter("_fwd")).select(*EVENT_COLUMNS)


def bec_inbox_rule_events(ual: DataFrame, prefilter: bool = False) -> DataFrame:
    return _events(bec_flagged(ual, prefilter).filter("_inbox")).select(*EVENT_COLUMNS)


def bec_delegation_events(ual: DataFrame, prefilter: bool = False) -> DataFrame:
    return _events(bec_flagged(ual, prefilter).filter("_deleg")).select(*EVENT_COLUMNS)


def email_domains(text_lower) -> "F.Column":
    """All e-mail domains in lower-cased text, lower-cased."""
    return F.transform(F.regexp_extract_all(text_lower, F.lit(K.EMAIL_PATTERN), 2), lambda d: F.lower(d))


def bec_external_domains(ual: DataFrame, top: int | None = None, text_col: str = "auditdata",
                         keyword_filter: bool = True, prefilter: bool = False) -> DataFrame:
    """Domains of every e-mail address in forwarding rows, counted (of which the first ``top`` on request).

    ``keyword_filter=False`` counts addresses in every row of ``text_col``.
    """
    if keyword_filter:
        rows = bec_flagged(ual.withColumnRenamed(text_col, "auditdata") if text_col != "auditdata" else ual,
                           prefilter).filter("_fwd")
        txt = F.lower(nz("auditdata"))
    else:
        rows = ual
        txt = F.lower(nz(text_col))
    doms = rows.select(F.explode(email_domains(txt)).alias("domain"))
    out = doms.groupBy("domain").agg(F.count(F.lit(1)).alias("count"))
    if top is not None:
        out = out.orderBy(F.desc("count"), F.asc("domain")).limit(top)
    return out


def union_bec_events(ual: DataFrame, per_kind: int | None = None, top: int | None = None,
                     prefilter: bool = False) -> DataFrame:
    """The three lists tagged with ``kind``, by time; a report may ask for the first ``per_kind`` rows of each list
    (scan order) and the first ``top`` of all."""
    flagged = bec_flagged(ual, prefilter)
    parts = []
    for no, (kind, flag) in enumerate([("forwarding", "_fwd"), ("inboxrule", "_inbox"), ("delegation", "_deleg")]):
        ev = _events(flagged.filter(flag))
        if per_kind is not None:
            ev = ev.orderBy("file_id", "rownum").limit(per_kind)
        parts.append(ev.withColumn("kind", F.lit(kind)).withColumn("_kno", F.lit(no)))
    u = parts[0].unionByName(parts[1]).unionByName(parts[2])
    u = u.orderBy("ts", "_kno", "file_id", "rownum")
    return (u if top is None else u.limit(top)).select(*EVENT_COLUMNS, "kind")
