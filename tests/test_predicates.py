"""Edge rows for the two sign-in outcome flavours, severity classes, scopes and time helpers."""
from pyspark.sql import functions as F

from auditlake.functions import predicates as P
from auditlake.functions.jsonfn import oauth_scopes, operation_fallback
from auditlake.functions.text import compress_text, py_list
from auditlake.functions.timefmt import epoch_dow, epoch_hour, iso_from_epoch, parse_epoch


def _eval(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_signin_outcomes(spark):
    rows = [("", ""), ("0", ""), ("00", ""), ("50126", ""), ("50076 mfa", ""), (" 0 ", ""), ("", "Success"),
            ("", "Failure"), ("0x", "blocked"), ("50076 mfa", "success")]
    got = _eval(spark, rows, "result_type string, status string", P.signin_success(), P.signin_failure(),
                P.sql_success(), P.sql_failure(), P.dashboard_failure())
    expect = [
        (False, False, False, False, True),   # '' : neither; dashboard counts empty as failure
        (True, False, True, False, False),    # '0'
        (True, False, True, False, True),     # '00' all digits zero; dashboard: != '0'
        (False, True, False, True, True),     # '50126'
        (False, False, False, True, True),    # '50076 mfa': python flavour neither, SQL flavour failure
        (True, False, False, False, True),    # ' 0 ': trimmed all digits; SQL: not starting with digit
        (True, False, True, False, True),
        (False, True, False, True, True),
        (False, True, True, False, True),     # '0x': py -> status blocked; SQL leading int 0 -> success
        (True, False, False, True, True),
    ]
    assert got == expect


def test_risk_and_legacy(spark):
    rows = [("high", "", "", "Exchange", "IMAP4"), ("low", "none", "", "Teams", "Browser"),
            ("", "atRisk", "", "x", "Other clients"), ("", "at risk", "", "x", "y"), ("", "", "", "pop", "")]
    got = _eval(spark, rows, "risk_level string, risk_state string, risk_detail string, app string, client_app string",
                P.risk_flagged(), P.risk_severity(), P.legacy_client())
    assert got == [(True, "high", True), (False, "medium", False), (True, "medium", True),
                   (True, "high", False), (False, "medium", True)]


def test_ual_severity_order(spark):
    rows = [("Set-MailboxCalendarConfiguration",), ("Add member to role.",), ("New-InboxRule",), ("Send",),
            ("Folder permission viewed",)]
    got = _eval(spark, rows, "operation string", P.ual_severity(), P.ual_hint())
    assert got == [("high", True), ("medium", True), ("high", True), ("", False), ("", True)]


def test_scopes_and_fallback(spark):
    rows = [('{"scope": "Files.Read offline_access", "x": "Sites.Read.All"}', ""),
            ('["scope", "mail.read"]', ""), ('{"Operation": "Set-Mailbox"}', ""), ("{broken", "")]
    got = _eval(spark, rows, "auditdata string, operation string", py_list(oauth_scopes("auditdata")),
                operation_fallback("operation", "auditdata"))
    assert got[0][0] == "['files.read', 'offline_access', 'sites.read.all']"
    assert got[1] == ("[]", "")
    assert got[2] == ("[]", "Set-Mailbox")
    assert got[3] == ("[]", "")


def test_time_helpers(spark):
    rows = [("2025-12-26T13:33:00Z",), ("2025-12-26 13:33:00",), ("2025-12-26T14:33:00+01:00",), ("1766755980",),
            ("1766755980000",), ("12/26/2025 1:33:00 PM",), ("nope",), (None,)]
    got = _eval(spark, rows, "s string", parse_epoch("s"))
    assert [g[0] for g in got] == [1766755980] * 6 + [None, None]
    got = _eval(spark, [(0,), (1766755980,), (-1,), (None,)], "e long", iso_from_epoch("e"), epoch_dow("e"),
                epoch_hour("e"))
    assert got[0] == ("1970-01-01T00:00:00+00:00", 4, 0)
    assert got[1] == ("2025-12-26T13:33:00+00:00", 5, 13)
    assert got[2] == ("1969-12-31T23:59:59+00:00", 3, 23)
    assert got[3][0] == ""


def test_compress_text(spark):
    got = _eval(spark, [("a" * 805,), ("short",)], "s string", compress_text("s", 800))
    assert got[0][0] == "a" * 800 + "… (+5 chars)"
    assert got[1][0] == "short"


def test_compress_evidence(spark):
    import json
    from auditlake.functions.jsonfn import compress_evidence
    ev = json.dumps({"s": "x" * 900, "o": {"k": "y" * 900}, "n": 5, "short": "ok", "l": [1, 2]})
    got = json.loads(_eval(spark, [(ev,)], "e string", compress_evidence("e", 800))[0][0])
    assert list(got) == ["s", "o", "n", "short", "l"]
    assert got["s"] == "x" * 800 + "… (+100 chars)"
    assert isinstance(got["o"], str) and got["o"].startswith('{"k":"yyy') and got["o"].endswith(" chars)")
    assert got["n"] == 5 and got["short"] == "ok" and got["l"] == [1, 2]


def test_time_text_meets_only_formats_it_can_fit(spark):
    """No text fits two beginnings, other cells fit none, and the result is that of trying every format."""
    import re

    from pyspark.sql import functions as F

    from auditlake.functions import timefmt as T
    formats = [f for own in T._ZONED_FORMATS.values() for f in own]
    times = ["2024-03-05T10:11:12.5", "2024-03-05 10:11", "2024/03/05 10:11:12", "3/5/2024 1:02 PM", "3/5/2024 13:02:03", "5.3.2024 10:11", "2024-03-05",
             "3/5/2024", "5-Mar-2024 10:11:12", "5 mar 2024 10:11", "MAR 5, 2024 1:02:03 AM", "Mar 5, 2024 13:02", "2024-03-05 1:02 pm",
             "20240305T101112", "05-Mar-2024", "Mar 15, 2024"]
    others = ["10.0.0.3", "u12@corp.example", "12@corp.example", '{"a": 1}', "Add member to role.", "3f2a9c10-0000-4000", "2001:db8::1", "Marketing", ""]
    odd = ["13/13/2024", "5.3.24 10:11", "5-Mai-2024", "Sept 5, 2024", "2024-3-5", " 2024-03-05", "\t2024-03-05 10:11", "+12024-03-05", "1:2", "12 members"]

    def begins(t):
        return [b for b in T._ZONED_FORMATS if re.search(b, t)]

    assert all(len(begins(t + "Z")) == 1 for t in times) and not any(begins(t + "Z") for t in others)
    assert all(re.search(T._POSSIBLE, t) for t in times) and not any(re.search(T._POSSIBLE, t) for t in others if t != "2001:db8::1")
    values = [(t + z,) for t in [*times, *others, *odd] for z in ("", "Z", " UTC", "+02:00")]
    z = F.when(F.col("s").rlike(T._HAS_ZONE), F.trim("s")).otherwise(F.concat(F.trim("s"), F.lit("Z")))
    whole = F.coalesce(F.try_to_timestamp(F.regexp_replace(z, r"(?i)\s*(utc|gmt)$", "Z")), *[F.try_to_timestamp(z, F.lit(f)) for f in formats])
    whole = F.when(~F.col("s").rlike(r"^t?\d{1,2}:\d{2}") & ~F.col("s").rlike(r"^\d+$"), F.unix_seconds(whole))
    found = spark.createDataFrame(values, "s string").where("s != '1:2'").select("s", T.parse_epoch("s").alias("e"), whole.alias("w")).collect()
    assert all(r["e"] == r["w"] for r in found), [r for r in found if r["e"] != r["w"]]
    assert sum(r["e"] is not None for r in found) >= 2 * len(times)
