"""DuckDB oracle SQL for every registered query.

Written independently of the Spark code (SQL formulations, CAST-based
integer tests, joins instead of windows where natural) so that the
side-by-side check compares two different derivations of the same
semantics.  All queries start from the adapter CTEs in
``sources.adapters.duckdb_views``.
"""

from __future__ import annotations

from .functions import constants as K
from .sources.adapters import duck_iso, duckdb_views

FINDING_OUT = ["finding_id", "severity", "category", "title", "timestamp", "user", "ip", "country", "file",
               "rownum", "sha256", "details"]


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def like_any(col: str, words) -> str:
    return "(" + " OR ".join(f"strpos({col}, {q(w)}) > 0" for w in words) + ")"


def with_views(*ctes: str, select: str) -> str:
    body = ",\n".join([duckdb_views()] + [c for c in ctes if c])
    return f"WITH {body}\n{select}"


# -- predicates ----------------------------------------------------------------

def lead_int(rt: str) -> str:
    return f"TRY_CAST(regexp_extract({rt}, '^[0-9]+') AS DOUBLE)"


def sql_failure(rt="result_type", st="status") -> str:
    return (f"(CASE WHEN {rt} GLOB '[0-9]*' THEN {lead_int(rt)} != 0 "
            f"ELSE {like_any(f'lower({st})', K.SQL_FAILURE_STATUS_WORDS)} END)")


def sql_success(rt="result_type", st="status") -> str:
    return (f"(CASE WHEN {rt} GLOB '[0-9]*' THEN {lead_int(rt)} = 0 "
            f"ELSE strpos(lower({st}), 'success') > 0 END)")


def _trim(rt: str) -> str:
    return f"regexp_replace({rt}, '^\\s+|\\s+$', '', 'g')"


def py_success(rt="result_type", st="status") -> str:
    t = _trim(rt)
    return (f"(CASE WHEN regexp_full_match({t}, '[0-9]+') THEN CAST({t} AS DOUBLE) = 0 "
            f"ELSE strpos(lower({st}), 'success') > 0 END)")


def py_failure(rt="result_type", st="status") -> str:
    t = _trim(rt)
    return (f"(CASE WHEN regexp_full_match({t}, '[0-9]+') THEN CAST({t} AS DOUBLE) != 0 "
            f"ELSE regexp_matches(lower({st}), 'fail|error|denied|blocked') END)")


def legacy(app="app", client="client_app") -> str:
    return like_any(f"lower(concat_ws(' ', {app}, {client}))", K.LEGACY_CLIENT_PATTERNS)


def ual_sev(op="operation") -> str:
    hi = "|".join(K.UAL_HIGH_PATTERNS)
    me = "|".join(K.UAL_MEDIUM_PATTERNS)
    return (f"(CASE WHEN regexp_matches(lower({op}), {q(hi)}) THEN 'high' "
            f"WHEN regexp_matches(lower({op}), {q(me)}) THEN 'medium' ELSE '' END)")


def finding_select(fid, sev, cat_key, ts, user="''", ip="''", country="''", file="'multiple'", rownum="''",
                   sha="''", details="''") -> str:
    cat, title = K.FINDING_META[cat_key]
    return (f"{fid} AS finding_id, {sev} AS severity, {q(cat)} AS category, {q(title)} AS title, "
            f"{ts} AS timestamp, {user} AS \"user\", {ip} AS ip, {country} AS country, {file} AS file, "
            f"{rownum} AS rownum, {sha} AS sha256, {details} AS details")


# -- aggregating detectors -------------------------------------------------------

def _campaign_cte(name, key, other, window_minutes, min_failures, min_other, top=None) -> str:
    win = int(window_minutes) * 60
    lim = f"LIMIT {top}" if top is not None else ""
    return f"""{name} AS (
  SELECT {key} AS k, ts_epoch // {win} AS bucket, count(*) AS fails, count(DISTINCT {other}) AS n_other,
         min(ts_epoch) AS min_ts, max(ts_epoch) AS max_ts
  FROM signin
  WHERE ts_epoch IS NOT NULL AND ip != '' AND "user" != '' AND (result_type != '' OR status != '')
    AND {sql_failure()}
  GROUP BY 1, 2
  HAVING count(*) >= {min_failures} AND count(DISTINCT {other}) >= {min_other}
  ORDER BY fails DESC, n_other DESC, k, bucket
  {lim})"""


def _ts_or_blank(c):
    return f"(CASE WHEN coalesce({c}, 0) != 0 THEN {duck_iso(c)} ELSE '' END)"


def spray_findings(window_minutes=15, min_failures=20, min_users=5, name="f_spray") -> str:
    cte = _campaign_cte(f"{name}_agg", "ip", '"user"', window_minutes, min_failures, min_users)
    det = (f"concat('failures=', fails, ' distinct_users=', n_other, ' window={window_minutes}m start=', "
           f"{duck_iso('min_ts')}, ' end=', {duck_iso('max_ts')})")
    sel = finding_select("concat('SPRAY-', k, '-', bucket)", "'high'", "password_spray", _ts_or_blank("min_ts"),
                         ip="k", details=det)
    return f"{cte},\n{name} AS (SELECT {sel} FROM {name}_agg)"


def brute_findings(window_minutes=15, min_failures=25, min_ips=5, name="f_brute") -> str:
    cte = _campaign_cte(f"{name}_agg", '"user"', "ip", window_minutes, min_failures, min_ips)
    det = (f"concat('failures=', fails, ' distinct_ips=', n_other, ' window={window_minutes}m start=', "
           f"{duck_iso('min_ts')}, ' end=', {duck_iso('max_ts')})")
    sel = finding_select("concat('BRUTE-', k, '-', bucket)", "'medium'", "bruteforce", _ts_or_blank("min_ts"),
                         user="k", details=det)
    return f"{cte},\n{name} AS (SELECT {sel} FROM {name}_agg)"


def findings_query(cte: str, name: str) -> str:
    cols = ", ".join(f'"{c}"' for c in FINDING_OUT)
    return with_views(cte, select=f"SELECT {cols} FROM {name}")


def with_views_rec(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + with_views(*ctes, select=select)[len("WITH "):]


def _cast(c: str) -> str:
    return f"CAST({c} AS VARCHAR)"


def _opt(cond: str, *parts: str) -> str:
    return f"(CASE WHEN {cond} THEN concat({', '.join(parts)}) ELSE '' END)"


TRIM = _trim


# -- row detectors -------------------------------------------------------------------

def risky_findings(name="f_risky") -> str:
    rl, rs, rd = (f"lower({TRIM(c)})" for c in ("risk_level", "risk_state", "risk_detail"))
    sev = f"(CASE WHEN rl IN ('high', 'medium') OR strpos(rs, 'at risk') > 0 THEN 'high' ELSE 'medium' END)"
    det = ("concat('risk_level=', risk_level, ' risk_state=', risk_state, ' risk_detail=', risk_detail, "
           "' app=', app, ' client=', client_app)")
    sel = finding_select("concat('RISKY-SIGNIN-', x.file_id, '-', x.rownum)", sev, "risky_signin", "ts_iso",
                         user='x."user"', ip="x.ip", country="x.country", file=_cast("x.file_id"),
                         rownum=_cast("x.rownum"), sha="coalesce(fl.sha256, '')", details=det)
    return f"""{name} AS (
  SELECT {sel}
  FROM (SELECT s.*, {rl} AS rl, {rs} AS rs, {rd} AS rd FROM signin s) x
  LEFT JOIN files fl ON fl.file_id = x.file_id
  WHERE NOT (rl = '' AND rs = '' AND rd = '')
    AND NOT (rl IN ('none', 'low', '') AND rs IN ('none', '') AND rd IN ('none', '')))"""


def legacy_findings(name="f_legacy") -> str:
    ec = _opt("error_code != ''", "' error_code='", "error_code")
    fr = _opt("failure_reason != ''", "' reason='", "failure_reason")
    det = ("concat('legacy_client=''', client_app, ''' app=''', app, ''' success=', "
           f"CASE WHEN ok THEN 'True' ELSE 'False' END, {ec}, {fr})")
    sel = finding_select("concat('LEGACY-AUTH-', x.file_id, '-', x.rownum)",
                         "(CASE WHEN ok THEN 'high' ELSE 'medium' END)", "legacy_auth", "ts_iso",
                         user='x."user"', ip="x.ip", country="x.country", file=_cast("x.file_id"),
                         rownum=_cast("x.rownum"), sha="coalesce(fl.sha256, '')", details=det)
    return f"""{name} AS (
  SELECT {sel}
  FROM (SELECT s.*, {py_success()} AS ok FROM signin s WHERE {legacy()}) x
  LEFT JOIN files fl ON fl.file_id = x.file_id)"""


def _danger_list(txt: str) -> str:
    arr = "[" + ", ".join(q(s) for s in K.DANGEROUS_OAUTH_SCOPES) + "]"
    return f"list_sort(list_filter({arr}, lambda d: strpos(coalesce({txt}, ''), d) > 0))"


def ual_findings(name="f_ual") -> str:
    jt = ("(CASE WHEN auditdata != '' AND json_type(TRY_CAST(auditdata AS JSON)) = 'OBJECT' "
          "THEN lower(CAST(TRY_CAST(auditdata AS JSON) AS VARCHAR)) END)")
    det = ("concat('operation=', operation, ' workload=', workload, ' record_type=', record_type, "
           "CASE WHEN fwd THEN ' forwarding_indicator=true' ELSE '' END, "
           "CASE WHEN inbox THEN ' inbox_rule_indicator=true' ELSE '' END, "
           "CASE WHEN len(dang) > 0 THEN concat(' dangerous_scopes=[''', array_to_string(dang, ''', '''), ''']') "
           "ELSE '' END)")
    sev = "(CASE WHEN len(dang) > 0 OR fwd THEN 'high' WHEN sev0 != '' THEN sev0 ELSE 'medium' END)"
    sel = finding_select("concat('UAL-', x.file_id, '-', x.rownum)", sev, "ual_suspicious", "ts_iso",
                         user='x."user"', ip="x.ip", file=_cast("x.file_id"), rownum=_cast("x.rownum"),
                         sha="coalesce(fl.sha256, '')", details=det)
    return f"""{name}_a AS (
  SELECT u.*, {ual_sev()} AS sev0, lower(auditdata) AS adl FROM ual u),
{name}_b AS (
  SELECT *, {like_any('adl', K.FORWARDING_KEYWORDS)} AS fwd,
         ({like_any('adl', K.INBOX_RULE_KEYWORDS)} OR strpos(lower(operation), 'inboxrule') > 0) AS inbox,
         {_danger_list(jt)} AS dang
  FROM {name}_a WHERE sev0 != '' OR {like_any('lower(operation)', K.UAL_HINT_WORDS)}),
{name} AS (
  SELECT {sel} FROM {name}_b x LEFT JOIN files fl ON fl.file_id = x.file_id)"""


def spike_findings(window_minutes=60, threshold=500, require_context=False, top=None,
                   name="f_spike") -> str:
    win = int(window_minutes) * 60
    ctx = (f"({like_any('lower(operation)', K.SPIKE_CONTEXT_OPERATION_WORDS)} OR "
           f"{like_any('lower(auditdata)', K.SPIKE_CONTEXT_AUDITDATA_WORDS)})")
    acc = (f"({like_any('lower(operation)', K.SPIKE_ACCESS_OPERATION_WORDS)} OR "
           f"{like_any('lower(auditdata)', K.SPIKE_ACCESS_AUDITDATA_WORDS)})")
    cond = f"{ctx} AND {acc}" if require_context else acc
    lim = f"LIMIT {top}" if top is not None else ""
    det = (f"concat('count=', cnt, ' in {window_minutes}m window start=', {duck_iso('min_ts')}, "
           f"' end=', {duck_iso('max_ts')})")
    sel = finding_select("concat('MAILSPIKE-', k, '-', bucket)", "'high'", "mailitems_spike",
                         _ts_or_blank("min_ts"), user="k", details=det)
    return f"""{name}_agg AS (
  SELECT "user" AS k, ts_epoch // {win} AS bucket, count(*) AS cnt, min(ts_epoch) AS min_ts, max(ts_epoch) AS max_ts
  FROM ual WHERE ts_epoch IS NOT NULL AND "user" != '' AND {cond}
  GROUP BY 1, 2 HAVING count(*) >= {threshold}
  ORDER BY cnt DESC, k, bucket {lim}),
{name} AS (SELECT {sel} FROM {name}_agg)"""


# -- sequences ---------------------------------------------------------------------------

def travel_findings(max_minutes=60, name="f_travel") -> str:
    W = int(max_minutes) * 60
    det = "concat('Successful sign-in from ', p_country, ' -> ', country, ' in ', (ts_epoch - p_ts) // 60, 'm')"
    sel = finding_select("concat('IMPTRAVEL-', x.\"user\", '-', x.file_id, '-', x.rownum, '-', x.ts_epoch)",
                         "'high'", "impossible_travel", "ts_iso", user='x."user"', ip="x.ip", country="x.country",
                         file=_cast("x.file_id"), rownum=_cast("x.rownum"), sha="coalesce(fl.sha256, '')",
                         details=det)
    return f"""{name}_a AS (
  SELECT "user", ts_epoch, file_id, rownum, country, ip, ts_iso,
         lag(ts_epoch) OVER w AS p_ts, lag(country) OVER w AS p_country
  FROM signin
  WHERE "user" != '' AND ts_epoch IS NOT NULL AND country != '' AND {py_success()}
  WINDOW w AS (PARTITION BY "user" ORDER BY ts_epoch, file_id, rownum)),
{name} AS (
  SELECT {sel} FROM {name}_a x LEFT JOIN files fl ON fl.file_id = x.file_id
  WHERE p_ts IS NOT NULL AND ts_epoch - p_ts BETWEEN 0 AND {W} AND country != p_country)"""


def saf_findings(max_minutes=30, min_fails=5, name="f_saf") -> str:
    """Needs WITH RECURSIVE.  Emission test: the m-th newest in-window failure comes after the
    previous emission."""
    W = int(max_minutes) * 60
    m = int(min_fails)
    hint = "CASE x.error_code " + " ".join(f"WHEN {q(k)} THEN {q(' (' + v + ')')}" for k, v in
                                           K.AADSTS_HINTS.items()) + " ELSE '' END"
    det = (f"concat(c.n, ' failures then success within {max_minutes}m; success_ip=', x.ip, ' app=', x.app, "
           f"' client=', x.client_app, {hint})")
    sel = finding_select("concat('SAF-', x.\"user\", '-', x.file_id, '-', x.rownum, '-', x.ts_epoch)", "'high'",
                         "success_after_failures", "x.ts_iso", user='x."user"', ip="x.ip", country="x.country",
                         file=_cast("x.file_id"), rownum=_cast("x.rownum"), sha="coalesce(fl.sha256, '')",
                         details=det)
    return f"""{name}_base AS (
  SELECT * FROM signin WHERE "user" != '' AND ts_epoch IS NOT NULL),
{name}_users AS (
  SELECT "user" FROM {name}_base GROUP BY "user"
  HAVING sum(CASE WHEN {sql_failure()} THEN 1 ELSE 0 END) >= {m}
     AND sum(CASE WHEN {sql_success()} THEN 1 ELSE 0 END) >= 1),
{name}_ev AS (
  SELECT b.*, {py_failure()} AS is_f, (NOT {py_failure()}) AND {py_success()} AS is_s
  FROM {name}_base b WHERE "user" IN (SELECT "user" FROM {name}_users)),
{name}_ev2 AS (
  SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts_epoch, file_id, rownum) AS rn
  FROM {name}_ev WHERE is_f OR is_s),
{name}_pairs AS (
  SELECT s."user", s.rn AS srn, f.rn AS frn,
         row_number() OVER (PARTITION BY s."user", s.rn ORDER BY f.rn DESC) AS pos
  FROM {name}_ev2 s JOIN {name}_ev2 f
    ON f."user" = s."user" AND f.is_f AND f.rn < s.rn AND s.ts_epoch - f.ts_epoch <= {W}
  WHERE s.is_s),
{name}_cand AS (SELECT "user", srn, frn AS kth FROM {name}_pairs WHERE pos = {m}),
{name}_rec(u, e) AS (
  SELECT "user", min(srn) FROM {name}_cand GROUP BY "user"
  UNION ALL
  SELECT u, nxt FROM (
    SELECT r.u, (SELECT min(c.srn) FROM {name}_cand c WHERE c."user" = r.u AND c.srn > r.e AND c.kth > r.e) AS nxt
    FROM {name}_rec r) t
  WHERE nxt IS NOT NULL),
{name}_em AS (SELECT u AS "user", e AS srn, lag(e) OVER (PARTITION BY u ORDER BY e) AS prev_e FROM {name}_rec),
{name}_cnt AS (
  SELECT em."user", em.srn, count(*) AS n FROM {name}_em em
  JOIN {name}_pairs p ON p."user" = em."user" AND p.srn = em.srn AND p.frn > coalesce(em.prev_e, 0)
  GROUP BY em."user", em.srn),
{name} AS (
  SELECT {sel} FROM {name}_cnt c JOIN {name}_ev2 x ON x."user" = c."user" AND x.rn = c.srn
  LEFT JOIN files fl ON fl.file_id = x.file_id)"""


def corr_ctes(max_minutes=60, last_n=5, drivers="severity", name="c") -> str:
    """As-of pairing by joins: newest sign-in at or before the audit row, then the newest success
    among it and its ``last_n - 1`` predecessors."""
    W = int(max_minutes) * 60
    if drivers == "severity":
        kw = like_any("lower(auditdata)", K.FORWARDING_KEYWORDS + K.INBOX_RULE_KEYWORDS)
        dr = f"""{name}_dr0 AS (SELECT u.*, {ual_sev()} AS sev0 FROM ual u WHERE ts_epoch IS NOT NULL AND "user" != ''),
{name}_dr AS (SELECT *, CASE WHEN sev0 != '' THEN sev0 ELSE 'high' END AS base FROM {name}_dr0
  WHERE sev0 != '' OR {kw})"""
    else:
        dr = f"""{name}_dr AS (SELECT u.*, '' AS base FROM ual u WHERE ts_epoch IS NOT NULL AND "user" != '')"""
    return f"""{name}_sg AS (
  SELECT "user", ts_epoch, file_id, rownum, {py_success()} AS ok, ts_iso, ip, country, app, client_app,
         risk_level, risk_state, risk_detail,
         row_number() OVER (PARTITION BY "user" ORDER BY ts_epoch, file_id, rownum) AS rn
  FROM signin WHERE ts_epoch IS NOT NULL AND "user" != ''),
{dr},
{name}_last AS (
  SELECT d.file_id, d.rownum, max(s.rn) AS lrn FROM {name}_dr d
  JOIN {name}_sg s ON s."user" = d."user" AND s.ts_epoch <= d.ts_epoch GROUP BY d.file_id, d.rownum),
{name}_best AS (
  SELECT d.file_id, d.rownum, max(s.rn) AS brn FROM {name}_last l
  JOIN {name}_dr d ON d.file_id = l.file_id AND d.rownum = l.rownum
  JOIN {name}_sg s ON s."user" = d."user" AND s.rn BETWEEN l.lrn - {int(last_n) - 1} AND l.lrn AND s.ok
  GROUP BY d.file_id, d.rownum),
{name}_pair AS (
  SELECT d.*, s.ts_epoch AS s_ts, s.ts_iso AS s_iso, s.ip AS s_ip, s.app AS s_app, s.client_app AS s_client,
         s.risk_level AS s_rl, s.risk_state AS s_rs, s.risk_detail AS s_rd, d.ts_epoch - s.ts_epoch AS dt
  FROM {name}_best b JOIN {name}_dr d ON d.file_id = b.file_id AND d.rownum = b.rownum
  JOIN {name}_sg s ON s."user" = d."user" AND s.rn = b.brn
  WHERE d.ts_epoch - s.ts_epoch BETWEEN 0 AND {W})"""


def corr_findings(max_minutes=60, last_n=5, name="f_corr") -> str:
    risky = " OR ".join(f"(lower({c}) != '' AND lower({c}) NOT IN ('none', 'low'))" for c in ("s_rl", "s_rs", "s_rd"))
    det = ("concat('UAL op ''', operation, ''' within ', dt // 60, 'm of successful sign-in (client=', s_client, "
           "'). ', concat_ws(' ', CASE WHEN risky THEN 'prior_signin_risky=true' END, "
           "CASE WHEN leg THEN 'prior_signin_legacy=true' END, CASE WHEN mism THEN 'ip_mismatch=true' END))")
    sev = "(CASE WHEN risky OR leg OR base = 'high' THEN 'high' ELSE 'medium' END)"
    sel = finding_select("concat('CORR-UAL-SIGNIN-', x.file_id, '-', x.rownum)", sev, "correlation", "x.ts_iso",
                         user='x."user"', ip="x.ip", file=_cast("x.file_id"), rownum=_cast("x.rownum"),
                         sha="coalesce(fl.sha256, '')", details=det)
    return f"""{corr_ctes(max_minutes, last_n, 'severity', name)},
{name}_n AS (
  SELECT *, ({risky}) AS risky, {legacy('s_client', 's_app')} AS leg,
         (s_ip != '' AND ip != '' AND s_ip != ip) AS mism FROM {name}_pair),
{name} AS (SELECT {sel} FROM {name}_n x LEFT JOIN files fl ON fl.file_id = x.file_id)"""


def corr_pairs_all(max_minutes=60, last_n=5) -> str:
    cte = corr_ctes(max_minutes, last_n, "all", "p")
    return with_views(cte, select=(
        'SELECT file_id AS ual_file_id, rownum AS ual_rownum, "user", ts_epoch AS ual_ts, s_ts AS signin_ts, '
        "s_ip AS signin_ip, dt AS delta_seconds FROM p_pair"))


# -- rules -------------------------------------------------------------------------------------

def rules_findings(rules: list[dict], name="f_rules") -> str:
    parts = []
    for r in rules:
        fam = str(r.get("family") or "").lower().strip()
        if fam not in ("ual", "signin") or r.get("name") is None:
            continue
        m = r.get("match") or {}
        if fam == "ual":
            text = "concat(operation, chr(10), auditdata)"
            src = "ual"
        else:
            text = ("concat(app, chr(10), client_app, chr(10), status, chr(10), result_type, chr(10), error_code, "
                    "chr(10), failure_reason, chr(10), raw_json)")
            src = "signin"
        conds = ["TRUE"]
        if m.get("contains_any"):
            conds.append(like_any(f"lower({text})", [str(w).lower() for w in m["contains_any"]]))
        if m.get("contains_all"):
            conds.append("(" + " AND ".join(f"strpos(lower({text}), {q(str(w).lower())}) > 0"
                                            for w in m["contains_all"]) + ")")
        if m.get("regex"):
            conds.append(f"regexp_matches({text}, {q(m['regex'])}, 'i')")
        rname = str(r["name"]).strip()
        title = str(r.get("title") or r["name"]).strip()
        sev = str(r.get("severity") or K.RULE_DEFAULT_SEVERITY).lower().strip()
        cat = str(r.get("category") or K.RULE_DEFAULT_CATEGORY).strip()
        desc = str(r.get("description") or "")
        parts.append(
            f"SELECT concat('RULE-', {q(rname)}, '-', t.file_id, '-', t.rownum) AS finding_id, {q(sev)} AS severity, "
            f"{q(cat)} AS category, {q(title)} AS title, t.ts_iso AS timestamp, t.\"user\" AS \"user\", t.ip AS ip, "
            f"'' AS country, {_cast('t.file_id')} AS file, {_cast('t.rownum')} AS rownum, "
            f"coalesce(fl.sha256, '') AS sha256, {q(desc)} AS details "
            f"FROM {src} t LEFT JOIN files fl ON fl.file_id = t.file_id WHERE {' AND '.join(conds)}")
    body = "\nUNION ALL\n".join(parts) if parts else "SELECT * FROM (SELECT " + ", ".join(
        f"'' AS \"{c}\"" for c in FINDING_OUT) + ") WHERE FALSE"
    return f"{name} AS (\n{body})"


# -- union of all detectors ------------------------------------------------------------------

def all_findings_ctes(p, rules=None, name="f_all") -> str:
    """CTEs for every detector with parameters ``p`` (a TriageParams) and their union ``f_all``."""
    ctes = [risky_findings(), legacy_findings(),
            spray_findings(p.spray_window, p.spray_min_failures, p.spray_min_users),
            brute_findings(p.brute_window, p.brute_min_failures, p.brute_min_ips),
            saf_findings(p.saf_minutes, p.saf_min_fails), travel_findings(p.travel_minutes), ual_findings()]
    members = [(1, "f_risky"), (2, "f_legacy"), (3, "f_spray"), (4, "f_brute"), (5, "f_saf"), (6, "f_travel"),
               (7, "f_ual")]
    if p.mode != "quick":
        ctes += [spike_findings(p.spike_window, p.spike_threshold, p.spike_require_context),
                 corr_findings(p.corr_minutes, p.corr_last_n)]
        members += [(8, "f_spike"), (9, "f_corr")]
    if rules:
        ctes.append(rules_findings(rules))
        members.append((10, "f_rules"))
    cols = ", ".join(f'"{c}"' for c in FINDING_OUT)
    union = "\nUNION ALL\n".join(f"SELECT {cols}, {no} AS detector_no FROM {n}" for no, n in members)
    ctes.append(f"{name} AS (\n{union})")
    return ",\n".join(ctes)
