"""Registered queries (one per operator of the coverage list) and their oracle SQL.

Every query reads the driver tables under ``sf_dir``: ``events`` projected to
sign-in / audit / file tables by ``sources.adapters`` and ``documents`` for
e-mail extraction over real text.  Keys mirror the SURVEY operator ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from . import registry_runs as runs
from .functions import constants as K
from .functions import predicates as P
from .functions.jsonfn import oauth_scopes
from .functions.text import nz, py_list
from .operators import bec, campaigns, correlate, findings as FN, pivots, row_detectors, rules as R, sequence
from .operators import timeline as TL
from .plans.triage import TEST_PARAMS, detect_all, quick
from .sources import adapters
from .sources.adapters import duck_iso

FINDING_OUT = O.FINDING_OUT

# Rules fixture (FIXTURES.md section 3): any / all / regex / empty match.
TEST_RULES = [
    {"name": "r_any", "family": "ual", "severity": "high", "category": "custom_rule",
     "match": {"contains_any": ["inboxrule", "set-mailbox"]}},
    {"name": "r_all", "family": "ual", "severity": "medium", "category": "exfil",
     "match": {"contains_all": ["permissions", "mail.read"]}},
    {"name": "r_rx", "family": "signin", "severity": "low", "category": "probe", "match": {"regex": r"IMAP\d"}},
    {"name": "r_empty", "family": "signin", "severity": None, "category": None, "match": {}},
    {"family": "ual", "severity": "high", "match": {"contains_any": ["x"]}},  # no name -> dropped
]


def _fo(df: DataFrame) -> DataFrame:
    return df.select(*FINDING_OUT)


def _tables(spark, sf):
    return adapters.load_tables(spark, sf)


def _signin(spark, sf):
    return adapters.load_tables(spark, sf)[0]


def _ual(spark, sf):
    return adapters.load_tables(spark, sf)[1]


def _findings(spark, sf, params=TEST_PARAMS, rules=TEST_RULES):
    s, u, f = _tables(spark, sf)
    return detect_all(s, u, f, rules, params)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fo(campaigns.det_bruteforce(_signin(spark, sf_dir), 1440, 4, 3))


_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def reg(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _Q[name] = fn
    if sql is not None:
        _SQL[name] = sql


V = O.with_views
VR = O.with_views_rec
P_ = TEST_PARAMS
FCOLS = ", ".join(f'"{c}"' for c in FINDING_OUT)

# ---------------------------------------------------------------------------
# 2.2 normalisation over the stand-in tables
# ---------------------------------------------------------------------------
reg("norm_signin", lambda s, d: adapters.signin_from_events(s, d),
    V(select="SELECT * FROM signin"))
reg("norm_ual", lambda s, d: adapters.ual_from_events(s, d),
    V(select="SELECT * FROM ual"))
reg("agg_file_stats", lambda s, d: pivots.agg_file_stats(_signin(s, d)),
    V(select='SELECT file_id, count(*) AS "rows", min(ts_epoch) AS start_epoch, max(ts_epoch) AS end_epoch '
             "FROM signin GROUP BY file_id"))

# ---------------------------------------------------------------------------
# 2.3 predicates (counted per outcome so both flavours are visible)
# ---------------------------------------------------------------------------


def _pred_counts(s, d):
    sg = _signin(s, d)
    return (sg.groupBy("result_type", "status")
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(P.signin_success().cast("int")).cast("long").alias("py_success"),
                 F.sum(P.signin_failure().cast("int")).cast("long").alias("py_failure"),
                 F.sum(P.sql_success().cast("int")).cast("long").alias("sql_success"),
                 F.sum(P.sql_failure().cast("int")).cast("long").alias("sql_failure"),
                 F.sum(P.dashboard_failure().cast("int")).cast("long").alias("dash_failure"),
                 F.max(P.signin_action()).alias("action")))


reg("pred_signin_outcomes", _pred_counts, V(select=f"""
SELECT result_type, status, count(*) AS n,
  CAST(sum(CASE WHEN {O.py_success()} THEN 1 ELSE 0 END) AS BIGINT) AS py_success,
  CAST(sum(CASE WHEN {O.py_failure()} THEN 1 ELSE 0 END) AS BIGINT) AS py_failure,
  CAST(sum(CASE WHEN {O.sql_success()} THEN 1 ELSE 0 END) AS BIGINT) AS sql_success,
  CAST(sum(CASE WHEN {O.sql_failure()} THEN 1 ELSE 0 END) AS BIGINT) AS sql_failure,
  CAST(sum(CASE WHEN result_type != '0' OR strpos(lower(status), 'fail') > 0 OR strpos(lower(status), 'error') > 0
           THEN 1 ELSE 0 END) AS BIGINT) AS dash_failure,
  max(CASE WHEN {O.py_failure()} THEN 'signin_failure' WHEN {O.py_success()} THEN 'signin_success'
           ELSE 'signin_event' END) AS action
FROM signin GROUP BY result_type, status"""))


def _ual_classes(s, d):
    u = _ual(s, d)
    ad_l = F.lower(nz("auditdata"))
    return (u.groupBy("operation", "auditdata")
            .agg(F.count(F.lit(1)).alias("n"))
            .select("operation", "auditdata", "n", P.ual_severity().alias("severity"),
                    P.ual_hint().alias("hint"), P.forwarding(ad_l).alias("forwarding"),
                    P.inbox_rule(ad_l).alias("inbox_rule"),
                    py_list(oauth_scopes("auditdata")).alias("scopes")))


_SCOPE_TXT = ("(CASE WHEN auditdata != '' AND json_type(TRY_CAST(auditdata AS JSON)) = 'OBJECT' "
              "THEN lower(CAST(TRY_CAST(auditdata AS JSON) AS VARCHAR)) END)")
_SCOPE_LIST = (
    "list_sort(list_distinct(list_concat("
    f"list_filter(flatten(list_transform(regexp_extract_all({_SCOPE_TXT}, {O.q(K.SCOPE_PATTERN)}, 1), "
    "lambda c: string_split_regex(c, '[ ,]+'))), lambda p: length(trim(p)) BETWEEN 1 AND 60), "
    "list_filter([" + ", ".join(O.q(x) for x in K.DANGEROUS_OAUTH_SCOPES) + "], "
    f"lambda d: strpos(coalesce({_SCOPE_TXT}, ''), d) > 0))))")
_SCOPE_RENDER = ("CASE WHEN {t} IS NULL OR len({l}) = 0 THEN '[]' "
                 "ELSE concat('[' || chr(39), array_to_string({l}, chr(39) || ', ' || chr(39)), chr(39) || ']') END")
reg("pred_ual_classes", _ual_classes, V(select=f"""
SELECT operation, auditdata, n, {O.ual_sev()} AS severity, {O.like_any('lower(operation)', K.UAL_HINT_WORDS)} AS hint,
  {O.like_any('lower(auditdata)', K.FORWARDING_KEYWORDS)} AS forwarding,
  ({O.like_any('lower(auditdata)', K.INBOX_RULE_KEYWORDS)} OR strpos(lower(operation), 'inboxrule') > 0) AS inbox_rule,
  {_SCOPE_RENDER.format(t=_SCOPE_TXT, l=_SCOPE_LIST)} AS scopes
FROM (SELECT operation, auditdata, count(*) AS n FROM ual GROUP BY operation, auditdata)"""))

# ---------------------------------------------------------------------------
# 2.4 row detectors, 2.6 aggregating, 2.7 sequences, 2.5 correlation
# ---------------------------------------------------------------------------
reg("det_risky_signin", lambda s, d: _fo(row_detectors.det_risky_signin(*_tables(s, d)[::2])),
    O.findings_query(O.risky_findings(), "f_risky"))
reg("det_legacy_auth", lambda s, d: _fo(row_detectors.det_legacy_auth(*_tables(s, d)[::2])),
    O.findings_query(O.legacy_findings(), "f_legacy"))


def _ual_det(s, d):
    sg, u, f = _tables(s, d)
    return _fo(row_detectors.det_ual_suspicious(u, f))


reg("det_ual_suspicious", _ual_det, O.findings_query(O.ual_findings(), "f_ual"))

reg("det_bruteforce", lambda s, d: _fo(campaigns.det_bruteforce(_signin(s, d), 360, 6, 4)),
    O.findings_query(O.brute_findings(360, 6, 4), "f_brute"))
reg("det_bruteforce_day", lambda s, d: _fo(campaigns.det_bruteforce(_signin(s, d), 1440, 4, 3)),
    O.findings_query(O.brute_findings(1440, 4, 3), "f_brute"))
reg("det_password_spray", lambda s, d: _fo(campaigns.det_password_spray(_signin(s, d), 360, 6, 4)),
    O.findings_query(O.spray_findings(360, 6, 4), "f_spray"))
reg("det_mailitems_spike", lambda s, d: _fo(campaigns.det_mailitems_spike(_ual(s, d), 360, 2, True)),
    O.findings_query(O.spike_findings(360, 2, True), "f_spike"))
reg("det_mailitems_spike_any", lambda s, d: _fo(campaigns.det_mailitems_spike(_ual(s, d), 60, 2, False, None)),
    O.findings_query(O.spike_findings(60, 2, False, None), "f_spike"))


def _travel(s, d):
    sg, u, f = _tables(s, d)
    return _fo(sequence.det_impossible_travel(sg, f, 60))


reg("det_impossible_travel", _travel, O.findings_query(O.travel_findings(60), "f_travel"))


def _saf(minutes, m):
    def run(s, d):
        sg, u, f = _tables(s, d)
        return _fo(sequence.det_success_after_failures(sg, f, minutes, m))
    return run


reg("det_success_after_failures", _saf(120, 3),
    VR(O.saf_findings(120, 3), select=f"SELECT {FCOLS} FROM f_saf"))
reg("det_success_after_failures_default", _saf(30, 5),
    VR(O.saf_findings(30, 5), select=f"SELECT {FCOLS} FROM f_saf"))


def _corr(s, d):
    sg, u, f = _tables(s, d)
    return _fo(correlate.det_correlation(sg, u, f, 60, 5))


reg("det_correlation", _corr, O.findings_query(O.corr_findings(60, 5), "f_corr"))
reg("join_asof_ual_signin", lambda s, d: correlate.correlation_pairs_all(_signin(s, d), _ual(s, d), 60, 5),
    O.corr_pairs_all(60, 5))


def _rules(fn, fam):
    def run(s, d):
        sg, u, f = _tables(s, d)
        out = fn(u if fam == "ual" else sg, TEST_RULES, f)
        return _fo(out)
    return run


reg("det_rules_ual", _rules(R.det_rules_ual, "ual"),
    O.findings_query(O.rules_findings([r for r in TEST_RULES if r.get("family") == "ual"]), "f_rules"))
reg("det_rules_signin", _rules(R.det_rules_signin, "signin"),
    O.findings_query(O.rules_findings([r for r in TEST_RULES if r.get("family") == "signin"]), "f_rules"))

# ---------------------------------------------------------------------------
# 2.8 BEC checklist
# ---------------------------------------------------------------------------
_BEC_CAND = ("(strpos(lower(auditdata), 'forward') > 0 OR strpos(lower(operation), 'inboxrule') > 0 "
             "OR strpos(lower(auditdata), 'inboxrule') > 0)")
_BEC_FWD = O.like_any("lower(auditdata)", K.FORWARDING_KEYWORDS)
_BEC_INBOX = f"(strpos(lower(operation), 'inbox') > 0 OR {O.like_any('lower(auditdata)', K.INBOX_RULE_KEYWORDS)})"
_BEC_DELEG = f"regexp_matches(lower(operation), {O.q(K.BEC_DELEGATION_PATTERN)})"
_BEC_SEL = "SELECT ts_iso AS ts, \"user\", ip, operation, concat(file_id, ':', rownum) AS ref FROM ual"
reg("bec_forwarding_events", lambda s, d: bec.bec_forwarding_events(_ual(s, d)),
    V(select=f"{_BEC_SEL} WHERE {_BEC_FWD}"))
reg("bec_inbox_rule_events", lambda s, d: bec.bec_inbox_rule_events(_ual(s, d)),
    V(select=f"{_BEC_SEL} WHERE {_BEC_INBOX}"))
reg("bec_delegation_events", lambda s, d: bec.bec_delegation_events(_ual(s, d)),
    V(select=f"{_BEC_SEL} WHERE {_BEC_DELEG}"))
reg("bec_forwarding_events_prefiltered", lambda s, d: bec.bec_forwarding_events(_ual(s, d), prefilter=True),
    V(select=f"{_BEC_SEL} WHERE {_BEC_CAND} AND {_BEC_FWD}"))
reg("bec_inbox_rule_events_prefiltered", lambda s, d: bec.bec_inbox_rule_events(_ual(s, d), prefilter=True),
    V(select=f"{_BEC_SEL} WHERE {_BEC_CAND} AND {_BEC_INBOX}"))
reg("bec_delegation_events_all", lambda s, d: bec.bec_delegation_events(_ual(s, d), prefilter=False),
    V(select=f"{_BEC_SEL} WHERE {_BEC_DELEG}"))
_DOM = O.q(K.EMAIL_PATTERN)
reg("bec_external_domains", lambda s, d: bec.bec_external_domains(_ual(s, d)),
    V(select=f"""SELECT lower(dm) AS domain, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(auditdata), {_DOM}, 2)) AS dm FROM ual WHERE {_BEC_FWD})
GROUP BY 1"""))


def _doc_domains(s, d):
    docs = s.read.parquet(f"{d}/documents.parquet")
    return bec.bec_external_domains(docs, text_col="text", keyword_filter=False, top=None)


reg("bec_external_domains_documents", _doc_domains,
    f"""SELECT lower(dm) AS domain, count(*) AS count FROM (
  SELECT unnest(regexp_extract_all(lower(text), {_DOM}, 2)) AS dm FROM documents) GROUP BY 1""")

_BEC_KIND = """SELECT ts_iso AS ts, "user", ip, operation, concat(file_id, ':', rownum) AS ref, '{kind}' AS kind FROM ual WHERE {cond}"""
reg("union_bec_events", lambda s, d: bec.union_bec_events(_ual(s, d)),
    V(select=" UNION ALL ".join(_BEC_KIND.format(kind=k, cond=c) for k, c in (
        ("forwarding", _BEC_FWD), ("inboxrule", _BEC_INBOX), ("delegation", _BEC_DELEG)))))

# ---------------------------------------------------------------------------
# 2.8 pivots over sign-ins / audit / files
# ---------------------------------------------------------------------------
reg("agg_top_fail_ips", lambda s, d: pivots.agg_top_fail(_signin(s, d), "ip"),
    V(select=f"SELECT ip, count(*) AS fails FROM signin WHERE ip != '' AND ts_epoch IS NOT NULL AND "
             f"{O.sql_failure()} GROUP BY ip ORDER BY fails DESC, ip LIMIT {K.TOP_FAIL}"))
reg("agg_top_fail_users", lambda s, d: pivots.agg_top_fail(_signin(s, d), "user"),
    V(select=f"SELECT \"user\", count(*) AS fails FROM signin WHERE \"user\" != '' AND ts_epoch IS NOT NULL AND "
             f"{O.sql_failure()} GROUP BY \"user\" ORDER BY fails DESC, \"user\" LIMIT {K.TOP_FAIL}"))
_DASH = "(result_type != '0' OR strpos(lower(status), 'fail') > 0 OR strpos(lower(status), 'error') > 0)"
reg("agg_dash_fail_ips", lambda s, d: pivots.agg_dash_fail(_signin(s, d), "ip", "user"),
    V(select=f"SELECT ip, CAST(sum(CASE WHEN {_DASH} THEN 1 ELSE 0 END) AS BIGINT) AS fails, "
             f"count(DISTINCT \"user\") AS users FROM signin WHERE ip != '' GROUP BY ip "
             f"ORDER BY fails DESC, users DESC, ip LIMIT {K.TOP_DASH_FAIL}"))
reg("agg_dash_fail_users", lambda s, d: pivots.agg_dash_fail(_signin(s, d), "user", "ip"),
    V(select=f"SELECT \"user\", CAST(sum(CASE WHEN {_DASH} THEN 1 ELSE 0 END) AS BIGINT) AS fails, "
             f"count(DISTINCT ip) AS ips FROM signin WHERE \"user\" != '' GROUP BY \"user\" "
             f"ORDER BY fails DESC, ips DESC, \"user\" LIMIT {K.TOP_DASH_FAIL}"))
_DAY = "CAST(CAST(make_timestamp(ts_epoch * 1000000) AS DATE) AS VARCHAR)"
reg("agg_signin_by_day", lambda s, d: pivots.agg_by_day(_signin(s, d)),
    V(select=f"SELECT {_DAY} AS date, count(*) AS count FROM signin WHERE ts_epoch IS NOT NULL GROUP BY 1"))
reg("agg_ual_by_day", lambda s, d: pivots.agg_by_day(_ual(s, d)),
    V(select=f"SELECT {_DAY} AS date, count(*) AS count FROM ual WHERE ts_epoch IS NOT NULL GROUP BY 1"))
reg("agg_heatmap", lambda s, d: pivots.agg_heatmap(_signin(s, d)),
    V(select="""SELECT CAST(g.dow AS BIGINT) AS dow, CAST(g.hour AS BIGINT) AS hour, coalesce(c.count, 0) AS count
FROM (SELECT d AS dow, h AS hour FROM range(7) t1(d), range(24) t2(h)) g
LEFT JOIN (SELECT dayofweek(make_timestamp(ts_epoch * 1000000)) AS dow, hour(make_timestamp(ts_epoch * 1000000)) AS hour,
                  count(*) AS count FROM signin WHERE ts_epoch IS NOT NULL GROUP BY 1, 2) c
  ON c.dow = g.dow AND c.hour = g.hour"""))
reg("agg_user_signin_summary", lambda s, d: pivots.agg_user_signin_summary(_signin(s, d)),
    V(select=f"SELECT \"user\", CAST(sum(CASE WHEN {O.sql_success()} THEN 1 ELSE 0 END) AS BIGINT) AS success, "
             f"CAST(sum(CASE WHEN {O.sql_failure()} THEN 1 ELSE 0 END) AS BIGINT) AS fail, "
             f"count(DISTINCT ip) AS ips FROM signin WHERE \"user\" != '' GROUP BY \"user\""))
reg("agg_top_case_users", lambda s, d: pivots.agg_top_case_users(_signin(s, d), _ual(s, d)),
    V(select=f"""SELECT "user", CAST(sum(c) AS BIGINT) AS events FROM (
  SELECT "user", count(*) AS c FROM ual WHERE "user" != '' GROUP BY "user"
  UNION ALL SELECT "user", count(*) AS c FROM signin WHERE "user" != '' GROUP BY "user")
GROUP BY "user" ORDER BY events DESC, "user" LIMIT {K.CASE_TOP_USERS}"""))


def _files(s, d):
    return _tables(s, d)[2]


reg("agg_coverage", lambda s, d: pivots.agg_coverage(_files(s, d)),
    V(select=f"""SELECT min(start_epoch) AS start_epoch, max(end_epoch) AS end_epoch,
  CASE WHEN coalesce(min(start_epoch), 0) != 0 THEN {duck_iso('min(start_epoch)')} ELSE '' END AS start,
  CASE WHEN coalesce(max(end_epoch), 0) != 0 THEN {duck_iso('max(end_epoch)')} ELSE '' END AS "end"
FROM files WHERE start_epoch IS NOT NULL AND end_epoch IS NOT NULL"""))
reg("agg_family_counts", lambda s, d: pivots.agg_family_counts(_files(s, d)),
    V(select='SELECT family, CAST(sum("rows") AS BIGINT) AS "rows" FROM files GROUP BY family'))
reg("list_files", lambda s, d: pivots.list_files(_files(s, d)),
    V(select=f"""SELECT name, family, CAST("rows" AS BIGINT) AS "rows", sha256, delimiter, CAST(skiprows AS BIGINT) AS skiprows,
  CASE WHEN coalesce(start_epoch, 0) != 0 THEN {duck_iso('start_epoch')} ELSE '' END AS start,
  CASE WHEN coalesce(end_epoch, 0) != 0 THEN {duck_iso('end_epoch')} ELSE '' END AS "end", path FROM files"""))


def _case_events(s, d):
    sg, u = _signin(s, d), _ual(s, d)
    top = pivots.agg_top_case_users(sg, u)
    return TL.last_n_user_events(sg, u, K.CASE_LAST_EVENTS, users=top).select(*TL.CASE_COLUMNS, "user_key")


_CASE_SQL = f"""top AS (
  SELECT "user" FROM (
    SELECT "user", count(*) AS c FROM ual WHERE "user" != '' GROUP BY "user"
    UNION ALL SELECT "user", count(*) AS c FROM signin WHERE "user" != '' GROUP BY "user")
  GROUP BY "user" ORDER BY sum(c) DESC, "user" LIMIT {K.CASE_TOP_USERS}),
ev AS (
  SELECT "user", ts_epoch, 0 AS src_no, file_id, rownum, ts_iso AS ts, 'signin' AS src, ip, 'signin' AS action,
    concat('app=', app, ' client=', client_app, ' status=', status, ' result=', result_type,
           CASE WHEN error_code != '' THEN concat(' ec=', error_code) ELSE '' END,
           CASE WHEN failure_reason != '' THEN concat(' fr=', failure_reason) ELSE '' END) AS detail,
    concat(file_id, ':', rownum) AS ref
  FROM signin WHERE "user" != '' AND ts_epoch IS NOT NULL
  UNION ALL
  SELECT "user", ts_epoch, 1, file_id, rownum, ts_iso, 'ual', ip, 'ual', concat('op=', operation, ' workload=', workload),
    concat(file_id, ':', rownum) FROM ual WHERE "user" != '' AND ts_epoch IS NOT NULL),
ranked AS (
  SELECT ev.*, row_number() OVER (PARTITION BY "user" ORDER BY ts_epoch DESC, src_no DESC, file_id DESC, rownum DESC) AS rn
  FROM ev WHERE "user" IN (SELECT "user" FROM top))"""
reg("win_last_n_user_events", _case_events,
    V(_CASE_SQL, select=f"""SELECT "user", ts, src, ip, action, detail, ref,
  replace(replace("user", '@', '_at_'), '/', '_') AS user_key FROM ranked WHERE rn <= {K.CASE_LAST_EVENTS}"""))

reg("union_case_timeline", lambda s, d: TL.case_events(_signin(s, d), _ual(s, d)).select(*TL.CASE_COLUMNS),
    V(_CASE_SQL, select='SELECT "user", ts, src, ip, action, detail, ref FROM ev'))
reg("semi_saf_users", lambda s, d: sequence.saf_candidate_users(_signin(s, d), 3),
    V(select=f"""SELECT "user" FROM signin WHERE "user" != '' AND ts_epoch IS NOT NULL GROUP BY "user"
HAVING sum(CASE WHEN {O.sql_failure()} THEN 1 ELSE 0 END) >= 3 AND sum(CASE WHEN {O.sql_success()} THEN 1 ELSE 0 END) >= 1"""))

# timelines
_TL_SIGNIN = f"""SELECT ts_iso AS ts, ts_epoch AS epoch, 'signin' AS source, "user", ip,
  CASE WHEN {O.py_failure()} THEN 'signin_failure' WHEN {O.py_success()} THEN 'signin_success' ELSE 'signin_event' END AS action,
  concat('app=', app, ' client=', client_app, ' status=', status, ' result=', result_type,
    CASE WHEN error_code != '' THEN concat(' error_code=', error_code) ELSE '' END,
    CASE WHEN failure_reason != '' THEN concat(' reason=', failure_reason) ELSE '' END,
    CASE WHEN country != '' THEN concat(' country=', country) ELSE '' END) AS detail,
  concat(file_id, ':', rownum) AS ref FROM signin WHERE ts_epoch IS NOT NULL"""
_TL_UAL = """SELECT ts_iso AS ts, ts_epoch AS epoch, 'ual' AS source, "user", ip, operation AS action, workload AS detail,
  concat(file_id, ':', rownum) AS ref FROM ual WHERE ts_epoch IS NOT NULL"""
_SUSP = (f"({O.ual_sev()} != '' OR {O.like_any('lower(auditdata)', K.FORWARDING_KEYWORDS + K.INBOX_RULE_KEYWORDS)} "
         "OR strpos(lower(operation), 'mailitemsaccessed') > 0)")
reg("union_timeline_deep", lambda s, d: TL.union_timeline(_signin(s, d), _ual(s, d), "deep"),
    V(select=f"{_TL_UAL}\nUNION ALL\n{_TL_SIGNIN}"))
reg("union_timeline_quick", lambda s, d: TL.union_timeline(_signin(s, d), _ual(s, d), "quick"),
    V(select=f"{_TL_UAL} AND {_SUSP}"))

# ---------------------------------------------------------------------------
# findings union and everything computed from it
# ---------------------------------------------------------------------------
_ALL = O.all_findings_ctes(P_, TEST_RULES)
_ALL_Q = O.all_findings_ctes(quick(P_), None)


def _fa(s, d):
    return _findings(s, d)


reg("union_findings", lambda s, d: _fa(s, d).select(*FINDING_OUT, "detector_no"),
    VR(_ALL, select=f"SELECT {FCOLS}, detector_no FROM f_all"))
reg("union_findings_quick", lambda s, d: _findings(s, d, quick(P_), None).select(*FINDING_OUT, "detector_no"),
    VR(_ALL_Q, select=f"SELECT {FCOLS}, detector_no FROM f_all"))
reg("union_findings_default", lambda s, d: _findings(s, d, type(P_)(), None).select(*FINDING_OUT, "detector_no"),
    VR(O.all_findings_ctes(type(P_)(), None), select=f"SELECT {FCOLS}, detector_no FROM f_all"))

reg("agg_severity_counts", lambda s, d: pivots.agg_severity_counts(_fa(s, d)),
    VR(_ALL, select="SELECT lower(severity) AS severity, count(*) AS count FROM f_all GROUP BY 1"))
reg("agg_category_counts", lambda s, d: pivots.agg_category_counts(_fa(s, d)),
    VR(_ALL, select=f"SELECT category, count(*) AS count FROM f_all GROUP BY 1"))
_SCORE = ("CAST(least(100, 35 * sum(CASE WHEN lower(severity) = 'critical' THEN 1 ELSE 0 END) + "
          "20 * sum(CASE WHEN lower(severity) = 'high' THEN 1 ELSE 0 END) + "
          "8 * sum(CASE WHEN lower(severity) = 'medium' THEN 1 ELSE 0 END) + "
          "2 * sum(CASE WHEN lower(severity) = 'low' THEN 1 ELSE 0 END)) AS BIGINT)")
reg("agg_risk_score", lambda s, d: pivots.agg_risk_score(_fa(s, d)),
    VR(_ALL, select=f"""SELECT risk_score, CASE WHEN risk_score >= 85 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH'
  WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_label FROM (SELECT {_SCORE} AS risk_score FROM f_all)"""))


def _kpis(s, d):
    sg, u, f = _tables(s, d)
    return pivots.agg_kpis(detect_all(sg, u, f, TEST_RULES, P_), f, sg, u)


reg("agg_kpis", _kpis, VR(_ALL, select=f"""SELECT
  (SELECT {_SCORE} FROM f_all) AS risk_score,
  (SELECT count(*) FROM files) AS total_files,
  (SELECT count(*) FROM f_all) AS total_findings,
  (SELECT count(DISTINCT "user") FROM f_all WHERE "user" != '') AS impacted_users,
  (SELECT count(DISTINCT ip) FROM f_all WHERE ip != '') AS impacted_ips,
  (SELECT count(*) FROM signin) AS signin_rows,
  (SELECT count(*) FROM ual) AS ual_rows"""))
reg("agg_impacted_users", lambda s, d: pivots.agg_impacted(_fa(s, d), "user"),
    VR(_ALL, select=f'SELECT DISTINCT "user" FROM f_all WHERE "user" != \'\''))
reg("agg_impacted_ips", lambda s, d: pivots.agg_impacted(_fa(s, d), "ip"),
    VR(_ALL, select=f"SELECT DISTINCT ip FROM f_all WHERE ip != ''"))
reg("agg_impacted_countries", lambda s, d: pivots.agg_impacted_countries(_fa(s, d)),
    VR(_ALL, select=f"SELECT country, count(*) AS count FROM f_all WHERE country != '' GROUP BY 1"))
_FDAY = "CAST(CAST(CAST(timestamp AS TIMESTAMPTZ) AT TIME ZONE 'UTC' AS DATE) AS VARCHAR)"
reg("agg_findings_by_day", lambda s, d: pivots.agg_findings_by_day(_fa(s, d)),
    VR(_ALL, select=f"SELECT {_FDAY} AS date, count(*) AS count FROM f_all WHERE timestamp != '' GROUP BY 1"))


def _daily(s, d):
    sg, u, f = _tables(s, d)
    fa = detect_all(sg, u, f, TEST_RULES, P_)
    return pivots.join_daily_series(pivots.agg_by_day(sg), pivots.agg_by_day(u), pivots.agg_findings_by_day(fa))


reg("join_daily_series", _daily, VR(_ALL, select=f"""SELECT date, CAST(sum(si) AS BIGINT) AS signin,
  CAST(sum(ua) AS BIGINT) AS ual, CAST(sum(fi) AS BIGINT) AS findings, CAST(sum(si) + sum(ua) AS BIGINT) AS total
FROM (
  SELECT {_DAY} AS date, 1 AS si, 0 AS ua, 0 AS fi FROM signin WHERE ts_epoch IS NOT NULL
  UNION ALL SELECT {_DAY}, 0, 1, 0 FROM ual WHERE ts_epoch IS NOT NULL
  UNION ALL SELECT {_FDAY}, 0, 0, 1 FROM f_all WHERE timestamp != '')
GROUP BY date ORDER BY date DESC LIMIT {K.DAILY_LAST_DAYS}"""))

_REP_RANK = ("CASE lower(severity) WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 "
             "ELSE 9 END")
_CMP = ("CASE WHEN length({c}) > 800 THEN concat(substr({c}, 1, 800), '… (+', length({c}) - 800, ' chars)') "
        "ELSE {c} END")
reg("topk_findings_embed", lambda s, d: FN.topk_findings_embed(_fa(s, d)).drop("evidence_json"),
    VR(_ALL, select=f"""SELECT finding_id, severity, category, title, timestamp, "user", ip, country, file, rownum, sha256,
  {_CMP.format(c='details')} AS details
FROM f_all ORDER BY {_REP_RANK}, timestamp, finding_id LIMIT {K.REPORT_EMBED_TOP}"""))
reg("topk_high_findings", lambda s, d: FN.topk_high_findings(_fa(s, d)).select(*FINDING_OUT, "detector_no"),
    VR(_ALL, select=f"""SELECT {FCOLS}, detector_no FROM f_all WHERE lower(severity) = 'high'
ORDER BY detector_no, TRY_CAST(file AS BIGINT) NULLS LAST, TRY_CAST(rownum AS BIGINT) NULLS LAST, finding_id
LIMIT {K.TOP_HIGH_FINDINGS}"""))
reg("findings_timeline", lambda s, d: FN.findings_timeline(_fa(s, d)),
    VR(_ALL, select=f"""SELECT timestamp AS ts, severity, title, category, "user", ip,
  CASE WHEN file != '' AND rownum != '' THEN concat(file, ':', rownum) ELSE '' END AS ref, finding_id
FROM (SELECT * FROM f_all ORDER BY {_REP_RANK}, timestamp, finding_id LIMIT {K.REPORT_TIMELINE_TOP})
WHERE timestamp != ''"""))
_CSV_RANK = "CASE lower(severity) WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 WHEN 'info' THEN 3 ELSE 9 END"
reg("sort_findings", lambda s, d: FN.findings_with_position(_fa(s, d)).select(*FINDING_OUT, "position"),
    VR(_ALL, select=f"""SELECT {FCOLS}, row_number() OVER (ORDER BY {_CSV_RANK}, nullif(timestamp, '') NULLS LAST, finding_id) AS position FROM f_all"""))
reg("sort_findings_report", lambda s, d: FN.findings_with_position(_fa(s, d), report=True).select(*FINDING_OUT, "position"),
    VR(_ALL, select=f"SELECT {FCOLS}, row_number() OVER (ORDER BY {_REP_RANK}, timestamp, finding_id) AS position FROM f_all"))
reg("filter_findings_search",
    lambda s, d: FN.filter_findings_search(_fa(s, d), "high", None, "u1").select(*FINDING_OUT),
    VR(_ALL, select=f"""SELECT {FCOLS} FROM f_all WHERE lower(severity) = 'high' AND strpos(lower(concat_ws(' ',
  finding_id, severity, category, title, timestamp, "user", ip, file, rownum, details)), 'u1') > 0"""))
reg("list_findings_categories", lambda s, d: FN.list_findings_categories(_fa(s, d)),
    VR(_ALL, select="SELECT DISTINCT category FROM f_all WHERE category != ''"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# ---------------------------------------------------------------------------
# CSV ingest: a folder of exports written from the stand-in rows, read back by ingest_logs
# ---------------------------------------------------------------------------
_SIGNIN_TEXT = ["user", "ip", "app", "client_app", "user_agent", "device_id", "correlation_id", "result_type", "error_code",
                "failure_reason", "status", "risk_level", "risk_state", "risk_detail", "country", "state", "city"]
_UAL_TEXT = ["user", "ip", "operation", "workload", "record_type", "object_id", "auditdata"]


def _ingested(no: int, cols: list[str]):
    return lambda s, d: adapters.load_ingested(s, d)[no].select("ts_epoch", "ts_iso", *cols)


def _duck_list(cols: list[str]) -> str:
    return ", ".join(f'"{c}"' for c in ["ts_epoch", "ts_iso", *cols])


reg("ingest_signin", _ingested(0, _SIGNIN_TEXT), V(select=f"SELECT {_duck_list(_SIGNIN_TEXT)} FROM signin"))
reg("ingest_ual", _ingested(1, _UAL_TEXT), V(select=f"SELECT {_duck_list(_UAL_TEXT)} FROM ual"))


def _ingest_files(s, d):
    """Per family, delimiter and encoding: rows, time range, and whether every file has its digest and no error."""
    f = adapters.load_ingested(s, d)[2]
    return f.groupBy("family", "delimiter", "encoding").agg(
        F.sum("rows").alias("rows"), F.min("start_epoch").alias("start_epoch"), F.max("end_epoch").alias("end_epoch"),
        F.min((F.length("sha256") == 64) & (F.col("error") == "")).alias("clean"))


def _ingest_files_sql() -> str:
    parts = []
    for family, variants in adapters.LOG_VARIANTS.items():
        for i, (_, _, sep, encoding, _) in enumerate(variants):
            # without a byte above 127 a file of either encoding is valid UTF-8
            parts.append(f"SELECT '{family}' AS family, {'chr(9)' if sep == chr(9) else O.q(sep)} AS delimiter, event_id % {len(variants)} = {i} AS own, "
                         f"{'ts_epoch + 600' if family == 'ual' else adapters.SIGNIN_RAW['ts_epoch']} AS ts FROM b")
    return ("SELECT family, delimiter, 'UTF-8' AS encoding, count(*) AS rows, min(ts) AS start_epoch, max(ts) AS end_epoch, true AS clean "
            f"FROM ({' UNION ALL '.join(parts)}) WHERE own GROUP BY family, delimiter")


reg("ingest_files", _ingest_files, V(select=_ingest_files_sql()))


def _ingest_rownums(s, d):
    """Per family: rows, and rows whose number is not one of 1..n of their file exactly once."""
    sg, u, _ = adapters.load_ingested(s, d)
    both = sg.select(F.lit("signin").alias("family"), "file_id", "rownum").unionByName(
        u.select(F.lit("ual").alias("family"), "file_id", "rownum"))
    per = both.groupBy("family", "file_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rownum").alias("own"),
                                                F.min("rownum").alias("low"), F.max("rownum").alias("high"))
    return per.groupBy("family").agg(F.sum("n").alias("rows"), F.sum(
        F.when((F.col("own") == F.col("n")) & (F.col("low") == 1) & (F.col("high") == F.col("n")), 0).otherwise(F.col("n"))).alias("misnumbered"))


reg("ingest_row_provenance", _ingest_rownums, V(select="""SELECT 'signin' AS family, count(*) AS rows, CAST(0 AS BIGINT) AS misnumbered FROM signin
UNION ALL SELECT 'ual', count(*), CAST(0 AS BIGINT) FROM ual"""))


def _ingest_raw_json(s, d):
    """Source columns of each audit row, from raw_json, by their names in the export."""
    u = adapters.load_ingested(s, d)[1]
    kv = F.from_json("raw_json", "map<string,string>")
    return u.select(F.element_at(kv, "UserId").alias("user"), F.element_at(kv, "Operation").alias("raw_operation"),
                    F.element_at(kv, "AuditData").alias("raw_auditdata"))


reg("ingest_raw_json", _ingest_raw_json, V(select='SELECT "user", operation AS raw_operation, auditdata AS raw_auditdata FROM ual_raw'))

# ---------------------------------------------------------------------------
# 2.11, 2.12 streams and sinks: run over the tables, results read back
# ---------------------------------------------------------------------------
reg("stream_password_spray", runs.stream_campaign("ip", 360, 6, 4), runs.stream_campaign_sql("ip", 360, 6, 4))
reg("stream_bruteforce", runs.stream_campaign("user", 1440, 4, 3), runs.stream_campaign_sql("user", 1440, 4, 3))
reg("stream_success_after_failures", runs.stream_saf, VR(O.saf_findings(120, 3), select="""SELECT "user", ip, file, rownum,
  CAST(split_part(details, ' ', 1) AS BIGINT) AS fail_count FROM f_saf"""))
reg("stream_row_detectors", runs.stream_rows, V(O.risky_findings(), O.legacy_findings(), O.ual_findings(), select=" UNION ALL ".join(
    f"SELECT {FCOLS} FROM {name}" for name in ("f_risky", "f_legacy", "f_ual"))))
reg("stream_ingest", runs.stream_ingest(_SIGNIN_TEXT), V(select=f"SELECT {_duck_list(_SIGNIN_TEXT)} FROM signin"))
reg("sink_normalized", runs.sink_normalized, V(select=f"""SELECT *, CASE WHEN ts_epoch IS NULL THEN 'unknown' ELSE {_DAY} END AS event_date FROM signin"""))
reg("sink_file_ranges", runs.sink_file_ranges, V(select=f"""SELECT name, family, "rows", {duck_iso('start_epoch')} AS start, {duck_iso('end_epoch')} AS "end", sha256 FROM files"""))
reg("sink_report_tables", runs.report_tables(_fa), runs.report_tables_sql(_ALL, _SCORE, _FDAY, _DAY, _DASH))
reg("fn_compress_text", runs.compressed_texts, runs.COMPRESSED_SQL)
