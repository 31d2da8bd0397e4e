"""CSV log-folder source: generated and messy files."""
import hashlib
import tempfile
from pathlib import Path

from pyspark.sql import functions as F

from auditlake.operators import bec, row_detectors
from auditlake.functions.timefmt import parse_epoch
from auditlake.sources import adapters
from auditlake.sources.logs import ingest_logs, resolve_headers
from conftest import SF001

def test_generated_folder(spark):
    """Digests, families, rows and findings of the log folder written from the given events."""
    logs = adapters.write_log_folder(spark, SF001)
    r = ingest_logs(spark, logs)
    files = r["files"].collect()
    on_disk = {p.name: hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(logs).rglob("*.csv")}
    assert {f["name"]: f["sha256"] for f in files} == on_disk and not any(f["error"] for f in files)
    s, u, _ = adapters.load_tables(spark, SF001)
    assert sum(f["rows"] for f in files) == s.count() + u.count()

    def severities(table):
        return {x["severity"]: x["count"] for x in row_detectors.det_ual_suspicious(table, None).groupBy("severity").count().collect()}

    assert severities(r["ual"]) == severities(u)
    assert bec.bec_forwarding_events(r["ual"]).count() == bec.bec_forwarding_events(u).count() > 0


def _write(d: Path, name: str, data: bytes):
    p = d / name
    p.write_bytes(data)
    return p


def test_messy_files(spark):
    d = Path(tempfile.mkdtemp(prefix="auditlake-messy-"))
    hdr = "CreationDate,UserId,ClientIP,Operation,Workload,AuditData\r\n"
    rows = "".join(f'2025-01-0{i}T10:00:0{i}Z,u{i}@x.com,1.1.1.{i},Set-Mailbox,Exchange,"{{""a"": {i}}}"\r\n'
                   for i in range(1, 6))
    _write(d, "ual_bom.csv", ("﻿" + hdr + rows).encode("utf-8"))
    _write(d, "ual_sep.csv", ("sep=;\n" + hdr.replace(",", ";") + rows.replace(",", ";").replace(
        '"{""a"";', '"{""a"":')).encode("utf-8"))
    _write(d, "audit_tab.csv", (hdr + rows).replace(",", "\t").encode("utf-8"))
    _write(d, "audit_pipe.csv", (hdr + rows).replace(",", "|").encode("utf-8"))
    _write(d, "audit_latin1.csv", (hdr + 'x,caf\xe9@x.com,1.1.1.1,Send,Exchange,"{}"\r\n').encode("latin-1"))
    _write(d, "tiny.csv", b"a,b")
    _write(d, "unified_header_only.csv", hdr.encode())
    _write(d, "audit_multiline.csv", (hdr + '2025-01-01T00:00:00Z,m@x.com,1.1.1.1,Send,Exchange,"{""t"": ""line1\r\nline2""}"\r\n'
                                      + "2025-01-01 01:00:00,n@x.com,1.1.1.2,Send,Exchange,{}\r\n").encode())
    _write(d, "audit_notime.csv", (hdr.replace("CreationDate", "Foo") + rows.replace("2025-01-0", "x")).encode())
    _write(d, "audit_dupes.csv", ("CreationDate,UserId,UserId,,Operation,AuditData\n"
                                  "2025-01-01T00:00:00Z,a@x,b@x,zz,Send,{}\n").encode())
    sig = ("Date,UserPrincipalName,AppDisplayName,ResultType\n"
           "1735725600,a@x.com,Teams,0\n1735725600000,b@x.com,Teams,50126\n2025-01-01T10:00:00+02:00,c@x.com,Teams,0\n")
    _write(d, "InteractiveSignIns_epochs.csv", sig.encode())
    r = ingest_logs(spark, str(d))
    files = {x["name"]: x for x in r["files"].collect()}
    assert files["tiny.csv"]["family"] == "empty" and files["tiny.csv"]["error"] == "empty file"
    assert files["ual_sep.csv"]["skiprows"] == 1 and files["ual_sep.csv"]["delimiter"] == ";"
    assert files["audit_tab.csv"]["delimiter"] == "\t" and files["audit_pipe.csv"]["delimiter"] == "|"
    assert files["audit_latin1.csv"]["encoding"] == "ISO-8859-1"
    for n in ("ual_bom.csv", "ual_sep.csv", "audit_tab.csv", "audit_pipe.csv"):
        assert files[n]["rows"] == 5, n
        assert files[n]["family"] == "ual"
    assert files["unified_header_only.csv"]["rows"] == 0
    assert files["audit_multiline.csv"]["rows"] == 2
    assert files["audit_notime.csv"]["rows"] == 0
    assert files["audit_dupes.csv"]["rows"] == 1
    ual = r["ual"].join(r["files"].select("file_id", "name"), "file_id")
    bom = sorted((x["rownum"], x["user"], x["ts_epoch"]) for x in ual.filter(F.col("name") == "ual_bom.csv").collect())
    assert [b[0] for b in bom] == [1, 2, 3, 4, 5] and bom[0][1] == "u1@x.com" and bom[0][2] == 1735725601
    sep = sorted((x["rownum"], x["user"]) for x in ual.filter(F.col("name") == "ual_sep.csv").collect())
    assert sep[0] == (1, "u1@x.com")
    lat = ual.filter(F.col("name") == "audit_latin1.csv").first()
    assert lat["user"] == "café@x.com" and lat["ts_epoch"] is None
    ml = sorted((x["rownum"], x["user"], x["ts_epoch"]) for x in
                ual.filter(F.col("name") == "audit_multiline.csv").collect())
    assert ml == [(1, "m@x.com", 1735689600), (2, "n@x.com", 1735693200)]
    sg = sorted((x["rownum"], x["ts_epoch"]) for x in r["signin"].collect())
    assert sg == [(1, 1735725600), (2, 1735725600), (3, 1735718400)]


def test_resolve_headers(spark):
    cols = ["Status.errorCode", "UserPrincipalName", "IpAddress", "ipaddress", "UserPrincipalName"]
    ual_cols = ["Client IP Address", "When", "My UserIds"]
    headers = spark.createDataFrame([("signin", cols), ("ual", ual_cols), ("ual", ["x"])], "family string, columns array<string>")
    got = {(r["family"], len(r["columns"])): r for r in resolve_headers(headers).collect()}
    fields = got["signin", 5]["fields"]
    assert fields["status"] == fields["result_type"] == 0 and fields["user"] == 1 and fields["ip"] == 3
    assert "city" not in fields and got["signin", 5]["time_pos"] is None
    assert got["ual", 3]["fields"]["ip"] == 0 and got["ual", 3]["fields"]["user"] == 2
    assert got["ual", 1]["fields"] is None and got["ual", 1]["time_pos"] is None
    assert resolve_headers(headers.where("false")).count() == 0


UAL_HEADER = "CreationDate,UserId,ClientIP,Operation,Workload,AuditData\n"


def test_no_file_loses_rows(spark):
    """Odd names, headers over 8 KiB, accents across that border, a bad file, ids that look like epochs, wrong delimiters."""
    d = Path(tempfile.mkdtemp(prefix="auditlake-odd-"))
    row = "2025-01-01T10:00:00Z,u@x.com,1.1.1.1,Send,Exchange,{}\n"
    names = ["ual export 1.csv", "ual_100%25.csv", "ual+plus.csv", "ual[1].csv"]
    for n in names:
        _write(d, n, (UAL_HEADER + row * 2).encode())
    wide = ",".join(f"a rather long column name {i:04d}" for i in range(400))
    _write(d, "audit_wide.csv", (wide + "," + UAL_HEADER + "v," * 400 + row).encode())
    _write(d, "audit_accent.csv", (UAL_HEADER + "2025-01-01T10:00:00Z,u@x.com,1.1.1.1,Send,Exchange," + "a" * 8100 + "é" * 400 + "\n").encode())
    (d / "audit_gone.csv").symlink_to(d / "nowhere.csv")
    _write(d, "audit_ids.csv", ("AccountNo,When,UserId,Operation,AuditData\n" + "".join(
        f"985000000{i},2025-01-05 10:00:0{i},u{i}@x,Send,x\n" for i in range(5))).encode())
    _write(d, "audit_semi.csv", ("CreationDate (UTC, ISO);UserId;ClientIP;Operation;Workload;AuditData\n" + "".join(
        f"2025-01-0{i}T00:00:00Z;u@x;1.1.1.1;Send;Exchange;a, b, c, d\n" for i in range(1, 6))).encode())
    r = ingest_logs(spark, str(d))
    files = {x["name"]: x for x in r["files"].collect()}
    assert all(files[n]["rows"] == 2 for n in names), files
    assert len(files["audit_wide.csv"]["columns"]) == 406 and files["audit_wide.csv"]["rows"] == 1
    assert files["audit_accent.csv"]["rows"] == 1 and files["audit_semi.csv"]["delimiter"] == ";"
    assert "audit_gone.csv" not in files or files["audit_gone.csv"]["error"]
    ual = r["ual"].join(r["files"].select("file_id", "name"), "file_id")
    wide_row = ual.filter("name = 'audit_wide.csv'").first()
    assert (wide_row["user"], wide_row["ip"], wide_row["auditdata"]) == ("u@x.com", "1.1.1.1", "{}")
    assert [x["ts_epoch"] for x in ual.filter("name = 'audit_ids.csv'").orderBy("rownum").collect()] == [1736071200 + i for i in range(5)]
    assert ual.filter("name = 'audit_semi.csv' and operation = 'Send' and ts_epoch is not null").count() == 5


def test_time_formats(spark):
    texts = ["05-Jan-2025 10:00:00", "Jan 5, 2025 10:00:00 AM", "2025-01-05 10:00:00 AM", "20250105T100000Z", "2025-01-05T10:00:00Z",
             "1/5/2025 10:00:00 AM", "2025-01-05 11:00:00+01:00", "1736071200", "10:00:00", "T10:00:00Z", "", "no time"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["e"] for r in df.select("i", parse_epoch(F.col("t")).alias("e")).orderBy("i").collect()]
    assert got == [1736071200] * 8 + [None] * 4


def test_unique_names():
    from auditlake.sources.records import unique_names
    assert unique_names(["a", "a", "", "a", "b"]) == ["a", "a.1", "Unnamed: 2", "a.2", "b"]
