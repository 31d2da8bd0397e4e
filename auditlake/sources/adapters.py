"""Stand-in ``signin`` / ``ual`` / ``files`` tables derived from the driver's ``events`` table.

The driver's test tables carry no identity logs, so these views project
``events`` onto the canonical raw columns (the shape a CSV scan yields).
They only produce input rows; every detector step runs afterwards through
the library's own normalisation and operators.  The same SQL expression text
is used by Spark and, in ``duckdb_views()``, by the DuckDB oracle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timefmt import epoch_of
from ..session import checkpoint_dir
from .normalize import normalize_signin, normalize_ual

# Raw sign-in columns over base ``b`` (event_id, user_id, event_type, value, ts_epoch, k).
SIGNIN_RAW = {
    "file_id": "CAST(event_id % 7 + 1 AS BIGINT)",
    "rownum": "event_id + 1",
    # every 500th event starts a burst: seven failures of one user, a minute apart, then a success
    "ts_epoch": "CASE WHEN event_id % 500 < 8 THEN 1735689600 + (event_id - event_id % 500) * 7 + event_id % 500 * 60 ELSE ts_epoch END",
    "user": "CASE WHEN event_id % 500 < 8 THEN concat('burst', CAST((event_id - event_id % 500) % 7 AS VARCHAR(20)), '@corp.example') WHEN event_id % 53 = 0 THEN '' ELSE concat('u', CAST(user_id % 40 AS VARCHAR(20)), '@corp.example') END",
    "ip": "CASE WHEN event_id % 47 = 0 THEN '' ELSE concat('10.0.0.', CAST(event_id % 12 AS VARCHAR(20))) END",
    "app": "CASE k % 3 WHEN 0 THEN 'Exchange Online' WHEN 1 THEN 'Azure Portal' ELSE 'Microsoft Teams' END",
    "client_app": ("CASE k % 7 WHEN 0 THEN 'IMAP4' WHEN 1 THEN 'POP3' WHEN 2 THEN 'Exchange ActiveSync' "
                   "WHEN 3 THEN 'Other clients' WHEN 4 THEN '' ELSE 'Browser' END"),
    "user_agent": "CASE k % 5 WHEN 0 THEN 'Mozilla/5.0' WHEN 1 THEN 'python-requests/2.31' ELSE '' END",
    "device_id": "CASE WHEN k % 4 = 0 THEN concat('dev-', CAST(user_id % 40 AS VARCHAR(20))) ELSE '' END",
    "correlation_id": "concat('corr-', CAST(event_id AS VARCHAR(20)))",
    "result_type": ("CASE WHEN event_id % 500 < 7 THEN '50126' WHEN event_id % 1000 = 7 THEN '0' WHEN event_id % 1000 = 507 "
                    "THEN '50076 mfa' ELSE CASE event_type WHEN 'error' THEN '50126' WHEN 'view' THEN '' WHEN 'click' THEN '50076 mfa' "
                    "ELSE '0' END END"),
    "failure_reason": "CASE WHEN event_type = 'error' THEN 'Invalid username or password.' ELSE '' END",
    "status": ("CASE WHEN event_id % 1000 = 507 THEN 'Success' WHEN event_type = 'view' AND k % 2 = 0 THEN 'Sign-in was Blocked' "
               "WHEN event_type = 'view' THEN 'Success' ELSE '' END"),
    "risk_level": "CASE k % 10 WHEN 0 THEN 'high' WHEN 1 THEN 'Medium' WHEN 2 THEN 'low' WHEN 3 THEN 'none' ELSE '' END",
    "risk_state": "CASE k % 11 WHEN 0 THEN 'atRisk' WHEN 1 THEN 'none' ELSE '' END",
    "risk_detail": "CASE k % 13 WHEN 0 THEN 'userPassedMFADrivenByRiskBasedPolicy' WHEN 1 THEN 'none' ELSE '' END",
    "country": "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'ES' WHEN 2 THEN 'US' ELSE 'BR' END",
    "state": "''",
    "city": "CASE event_id % 4 WHEN 1 THEN 'Madrid' WHEN 2 THEN 'Seattle' WHEN 3 THEN 'Sao Paulo' ELSE '' END",
    "raw_json": ("concat('{\"event_id\": ', CAST(event_id AS VARCHAR(20)), ', \"event_type\": \"', event_type, "
                 "'\", \"k\": ', CAST(k AS VARCHAR(20)), '}')"),
}

UAL_RAW = {
    "file_id": "CAST(event_id % 3 + 11 AS BIGINT)",
    "rownum": "event_id + 1",
    "ts_epoch": "ts_epoch + 600",
    "user": ("CASE WHEN event_id % 59 = 0 THEN '' ELSE concat('u', CAST((user_id + event_id) % 40 AS VARCHAR(20)), "
             "'@corp.example') END"),
    "ip": "CASE WHEN event_id % 31 = 0 THEN '' ELSE concat('10.0.0.', CAST((event_id + user_id) % 12 AS VARCHAR(20))) END",
    "operation": ("CASE WHEN event_id % 97 = 0 THEN '' WHEN event_id % 41 = 0 THEN 'Add-MailboxPermission' ELSE CASE k % 8 WHEN 0 THEN 'New-InboxRule' "
                  "WHEN 1 THEN 'Set-Mailbox' WHEN 2 THEN 'Add member to role.' WHEN 3 THEN 'MailItemsAccessed' "
                  "WHEN 4 THEN 'Consent to application' WHEN 5 THEN 'Folder permission viewed' WHEN 6 THEN 'Send' "
                  "ELSE 'FileAccessed' END END"),
    "workload": ("CASE k % 8 WHEN 2 THEN 'AzureActiveDirectory' WHEN 4 THEN 'AzureActiveDirectory' "
                 "WHEN 7 THEN 'SharePoint' ELSE 'Exchange' END"),
    "record_type": "CAST(k % 8 + 1 AS VARCHAR(20))",
    "object_id": "concat('obj-', CAST(k AS VARCHAR(20)))",
    "auditdata": ("CASE WHEN event_id % 89 = 0 THEN '{\"Operation\": \"Set-Mailbox\", \"broken\": ' "
                  "ELSE CASE k % 8 WHEN 0 THEN concat('{\"ForwardTo\": \"x', CAST(k AS VARCHAR(20)), '@evil', "
                  "CAST(k % 5 AS VARCHAR(20)), '.example\"}') "
                  "WHEN 3 THEN '{\"Operation\": \"MailItemsAccessed\", \"Redirect\": \"no\"}' "
                  "WHEN 4 THEN '{\"Permissions\": [\"Mail.Read\", \"User.Read\"], \"scope\": \"Files.Read offline_access\"}' "
                  "WHEN 6 THEN '[\"Operation\", \"Send\"]' "
                  "ELSE '{\"a\": 1}' END END"),
    "raw_json": "concat('{\"event_id\": ', CAST(event_id AS VARCHAR(20)), '}')",
}


def events_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.select("event_id", "user_id", "event_type", "value",
                     epoch_of(ev, "ts").alias("ts_epoch"),
                     F.get_json_object("props", "$.k").cast("int").alias("k"))


def _project(base: DataFrame, exprs: dict) -> DataFrame:
    return base.select(*[F.expr(e).alias(name) for name, e in exprs.items()])


def signin_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_signin(_project(events_base(spark, sf_dir), SIGNIN_RAW))


def ual_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_ual(_project(events_base(spark, sf_dir), UAL_RAW))


def files_from_tables(signin: DataFrame, ual: DataFrame) -> DataFrame:
    """File inventory of the stand-in tables: per file rows and time range.

    ``sha256`` is a stand-in digest of the file name (no file bytes exist).
    """
    def per_file(df, family):
        return (df.groupBy("file_id")
                .agg(F.count(F.lit(1)).alias("rows"), F.min("ts_epoch").alias("start_epoch"),
                     F.max("ts_epoch").alias("end_epoch"))
                .withColumn("family", F.lit(family)))
    both = per_file(signin, "signin").unionByName(per_file(ual, "ual"))
    name = F.concat(F.lit("events_"), F.col("family"), F.lit("_"), F.col("file_id").cast("string"), F.lit(".csv"))
    return both.select(
        "file_id", F.concat(F.lit("/data/"), name).alias("path"), name.alias("name"), "family",
        F.sha2(name, 256).alias("sha256"), "rows", F.lit(",").alias("delimiter"), F.lit(0).alias("skiprows"),
        "start_epoch", "end_epoch", F.lit("").alias("error"))


_MATERIALIZED: dict = {}


def _table_dir(spark: SparkSession, sf_dir: str) -> str:
    tag = hashlib.sha1(sf_dir.encode()).hexdigest()[:16]
    return f"{checkpoint_dir(spark).rstrip('/')}/auditlake-tables/{spark.sparkContext.applicationId}/{tag}"


def load_tables(spark: SparkSession, sf_dir: str, materialize: bool = True
                ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised (signin, ual, files) for ``sf_dir``.

    With ``materialize`` the tables are written once per application as
    Parquet under the shared checkpoint folder and read back, like the
    normalised tables an ingest run produces; detectors then read plain
    columns (pruned, with pushed-down filters) instead of re-deriving them.
    """
    if not materialize:
        signin = signin_from_events(spark, sf_dir)
        ual = ual_from_events(spark, sf_dir)
        return signin, ual, files_from_tables(signin, ual)
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MATERIALIZED:
        base = _table_dir(spark, sf_dir)
        signin_from_events(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/signin")
        ual_from_events(spark, sf_dir).write.mode("overwrite").parquet(f"{base}/ual")
        s = spark.read.parquet(f"{base}/signin")
        u = spark.read.parquet(f"{base}/ual")
        files_from_tables(s, u).write.mode("overwrite").parquet(f"{base}/files")
        _MATERIALIZED[key] = base
    base = _MATERIALIZED[key]
    return (spark.read.parquet(f"{base}/signin"), spark.read.parquet(f"{base}/ual"),
            spark.read.parquet(f"{base}/files"))


# ---------------------------------------------------------------------------
# Stand-in log folder: the same raw rows as exported CSV files.
# ---------------------------------------------------------------------------

_SIGNIN_HEADER = {"CreatedDateTime": "ts", "UserPrincipalName": "user", "IPAddress": "ip", "AppDisplayName": "app",
                  "ClientAppUsed": "client_app", "UserAgent": "user_agent", "DeviceId": "device_id", "CorrelationId": "correlation_id",
                  "ResultType": "result_type", "FailureReason": "failure_reason", "Status": "status",
                  "RiskLevelDuringSignIn": "risk_level", "RiskState": "risk_state", "RiskDetail": "risk_detail",
                  "Country": "country", "State": "state", "City": "city"}
_UAL_HEADER = {"When (UTC, ISO)": "ts", "UserId": "user", "ClientIP": "ip", "Operation": "operation", "Workload": "workload",
               "RecordType": "record_type", "ObjectId": "object_id", "AuditData": "auditdata"}
#: (folder, file name pattern, delimiter, encoding, time format; None: epoch seconds)
LOG_VARIANTS = {
    "signin": [("s0", "InteractiveSignIns {i}.csv", ",", "UTF-8", "yyyy-MM-dd'T'HH:mm:ss'Z'"),
               ("s1", "MSISignIns_100%25_{i}.csv", ";", "ISO-8859-1", "MM/dd/yyyy h:mm:ss a"),
               ("s2", "ApplicationSignIns+{i}.csv", "\t", "UTF-8", None)],
    "ual": [("u0", "ual export {i}.csv", ",", "UTF-8", "yyyy-MM-dd HH:mm:ss"),
            ("u1", "audit[{i}].csv", ";", "UTF-8", "dd-MMM-yyyy HH:mm:ss"),
            ("u2", "unified{i}.csv", "|", "ISO-8859-1", "MMM d, yyyy h:mm:ss a"),
            ("u3", "ual_{i}.csv", "\t", "UTF-8", "yyyyMMdd'T'HHmmss'Z'")],
}


def write_log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The raw stand-in rows as CSV exports under the shared folder: several delimiters, encodings, time formats and odd names."""
    out = f"{_table_dir(spark, sf_dir)}/logs"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    base = events_base(spark, sf_dir)
    for family, raw, header in (("signin", SIGNIN_RAW, _SIGNIN_HEADER), ("ual", UAL_RAW, _UAL_HEADER)):
        rows = base.select("event_id", *[F.expr(e).alias(n) for n, e in raw.items()])
        for i, (folder, name, sep, encoding, fmt) in enumerate(LOG_VARIANTS[family]):
            ts = F.col("ts_epoch").cast("string") if fmt is None else F.date_format(F.timestamp_seconds("ts_epoch"), fmt)
            part = rows.where(F.col("event_id") % len(LOG_VARIANTS[family]) == i).withColumn("ts", ts)
            (part.select(*[F.col(c).alias(h) for h, c in header.items()]).write.mode("overwrite").option("header", True)
             .option("sep", sep).option("quote", '"').option("escape", '"').option("encoding", encoding)
             .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(f"{out}/{folder}"))
            path = jvm.org.apache.hadoop.fs.Path(f"{out}/{folder}")
            fs = path.getFileSystem(conf)
            for k, st in enumerate(s for s in fs.listStatus(path) if s.getPath().getName().startswith("part-")):
                fs.rename(st.getPath(), jvm.org.apache.hadoop.fs.Path(path, name.format(i=k)))
    return out


_INGESTED: dict = {}


def load_ingested(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signin, ual, files) of the stand-in log folder, read by the library's CSV ingest and written once."""
    from .logs import counted_files, ingest_logs
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INGESTED:
        base = f"{_table_dir(spark, sf_dir)}/ingested"
        got = ingest_logs(spark, write_log_folder(spark, sf_dir))
        for name in ("signin", "ual"):
            got[name].write.mode("overwrite").parquet(f"{base}/{name}")
        # the counts of the files come from the rows just written
        files = counted_files(got["described"], *[spark.read.parquet(f"{base}/{name}") for name in ("signin", "ual")])
        files.write.mode("overwrite").parquet(f"{base}/files")
        _INGESTED[key] = base
    return tuple(spark.read.parquet(f"{_INGESTED[key]}/{name}") for name in ("signin", "ual", "files"))


# ---------------------------------------------------------------------------
# DuckDB text of the same views (used by the oracle SQL).
# ---------------------------------------------------------------------------

def _duck_cols(exprs: dict) -> str:
    return ",\n  ".join(f'{e} AS "{n}"' for n, e in exprs.items())


_WS_TRIM = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
DUCK_ISO = ("CASE WHEN {e} IS NULL THEN '' ELSE "
            "strftime(make_timestamp(CAST({e} AS BIGINT) * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') END")


def duck_iso(e: str) -> str:
    return DUCK_ISO.format(e=e)


def duckdb_views() -> str:
    """CTE text defining ``b``, ``signin``, ``ual`` and ``files`` for DuckDB."""
    sraw = _duck_cols(SIGNIN_RAW)
    uraw = _duck_cols(UAL_RAW)
    sfin = ", ".join(
        f'"{c}"' if c not in ("error_code", "ts_iso") else
        (f"regexp_extract({_WS_TRIM.format(x='result_type')}, '(\\d{{3,6}})', 1) AS error_code"
         if c == "error_code" else f"{duck_iso('ts_epoch')} AS ts_iso")
        for c in ["file_id", "rownum", "ts_epoch", "ts_iso", "user", "ip", "app", "client_app", "user_agent",
                  "device_id", "correlation_id", "result_type", "error_code", "failure_reason", "status",
                  "risk_level", "risk_state", "risk_detail", "country", "state", "city", "raw_json"])
    op_fb = ("CASE WHEN operation = '' THEN coalesce(CASE WHEN json_type(TRY_CAST(auditdata AS JSON)) = 'OBJECT' "
             "THEN json_extract_string(TRY_CAST(auditdata AS JSON), '$.Operation') END, '') ELSE operation END")
    ufin = ", ".join([
        "file_id", "rownum", "ts_epoch", f"{duck_iso('ts_epoch')} AS ts_iso", '"user"', "ip",
        f"{op_fb} AS operation", "workload", "record_type", "object_id", "auditdata", "raw_json"])
    fname = "concat('events_', family, '_', CAST(file_id AS VARCHAR), '.csv')"
    return f"""b AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000000 AS ts_epoch,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events),
signin_raw AS (SELECT
  {sraw}
  FROM b),
signin AS (SELECT {sfin} FROM signin_raw),
ual_raw AS (SELECT
  {uraw}
  FROM b),
ual AS (SELECT {ufin} FROM ual_raw),
files_agg AS (
  SELECT file_id, count(*) AS "rows", min(ts_epoch) AS start_epoch, max(ts_epoch) AS end_epoch, 'signin' AS family
  FROM signin GROUP BY file_id
  UNION ALL
  SELECT file_id, count(*) AS "rows", min(ts_epoch) AS start_epoch, max(ts_epoch) AS end_epoch, 'ual' AS family
  FROM ual GROUP BY file_id),
files AS (
  SELECT file_id, concat('/data/', {fname}) AS path, {fname} AS name, family, sha256({fname}) AS sha256,
         "rows", ',' AS delimiter, 0 AS skiprows, start_epoch, end_epoch, '' AS error
  FROM files_agg)"""
