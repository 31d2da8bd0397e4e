"""Registered queries that run a sink or a stream over the given tables and read back what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import constants as K
from .functions.text import compress_text
from .operators import report_counts
from .operators.sequence import saf_candidate_users
from .plans import sinks
from .session import checkpoint_dir
from .sources import adapters, increments
from .streaming import streams


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/auditlake-runs/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _stream_of(spark: SparkSession, df: DataFrame, at: str) -> DataFrame:
    """``df`` written, and read as a stream."""
    df.write.parquet(f"{at}/in")
    return spark.readStream.schema(df.schema).parquet(f"{at}/in")


def stream_campaign(key: str, minutes: int, failures: int, others: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = scratch(spark, f"campaign-{key}")
        rows = _stream_of(spark, adapters.load_tables(spark, sf_dir)[0], at)
        counted = streams.stream_campaign(rows, key, minutes, failures, others, watermark="1 day")
        streams.write_campaign_updates(counted, f"{at}/log", f"{at}/checkpoint").awaitTermination()
        return streams.latest_campaigns(spark, f"{at}/log", key).select(key, "bucket", "fails", "n_other", "min_ts", "max_ts")
    return run


def stream_campaign_sql(key: str, minutes: int, failures: int, others: int) -> str:
    k, other = ('ip', '"user"') if key == "ip" else ('"user"', 'ip')
    return O.with_views(select=f"""SELECT {k}, ts_epoch // {minutes * 60} AS bucket, count(*) AS fails, count(DISTINCT {other}) AS n_other,
  min(ts_epoch) AS min_ts, max(ts_epoch) AS max_ts FROM signin
WHERE ts_epoch IS NOT NULL AND ip != '' AND "user" != '' AND (result_type != '' OR status != '') AND {O.sql_failure()}
GROUP BY 1, 2 HAVING count(*) >= {failures} AND count(DISTINCT {other}) >= {others}""")


def stream_saf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of the users that the batch detector looks at: it asks for counts over all time, which a stream cannot know."""
    at = scratch(spark, "saf")
    signin = adapters.load_tables(spark, sf_dir)[0]
    rows = _stream_of(spark, signin.join(saf_candidate_users(signin, 3), "user", "left_semi").select(*signin.columns), at)
    found = streams.stream_success_after_failures(rows, 120, 3, watermark="0 seconds")
    found.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").select(
        "user", "ip", F.col("file_id").cast("string").alias("file"), F.col("rownum").cast("string").alias("rownum"), "fail_count")


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "rows")
    signin, ual, files = adapters.load_tables(spark, sf_dir)
    found = streams.stream_row_findings(_stream_of(spark, signin, f"{at}/signin"), _stream_of(spark, ual, f"{at}/ual"), files)
    found.writeStream.option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start(f"{at}/out").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{at}/out").select(*O.FINDING_OUT)


def stream_ingest(columns: list[str]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        at = scratch(spark, "ingest")
        logs = adapters.write_log_folder(spark, sf_dir)
        for _ in range(2):  # what is there is not read again
            streams.stream_ingest(spark, logs, f"{at}/tables", f"{at}/checkpoint", max_files_per_trigger=5).awaitTermination()
        return increments.current_tables(spark, f"{at}/tables")["signin"].select("ts_epoch", "ts_iso", *columns)
    return run


def sink_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "normalized")
    signin, ual, files = adapters.load_tables(spark, sf_dir)
    sinks.write_normalized(signin, ual, files, at)
    rows = spark.read.parquet(f"{at}/signin")
    return rows.select(*signin.columns, F.col("event_date").cast("string").alias("event_date"))


def sink_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "timeline")
    signin, ual, _ = adapters.load_tables(spark, sf_dir)
    sinks.write_timeline(signin, ual, at)
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{at}/timeline.csv")
    return rows.groupBy("source", "action").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("epoch").cast("long")).alias("first"),
                                                F.max(F.col("epoch").cast("long")).alias("last"))


def sink_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch(spark, "ranges")
    files = adapters.load_tables(spark, sf_dir)[2]
    sinks.write_file_ranges(files.withColumn("columns", F.array().cast("array<string>")), at)
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{at}/file_ranges.csv")
    return rows.select("name", "family", F.col("rows").cast("long").alias("rows"), "start", "end", "sha256")


def report_tables(findings):
    """(pivot, k1, k2, v1, v2) of all counting pivots, from one pass over each table."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        signin, ual, files = adapters.load_tables(spark, sf_dir)
        tables = report_counts.count_tables(findings(spark, sf_dir), signin, ual, files)
        shapes = {"severity_counts": ("severity", None, "count", None), "category_top": ("category", None, "count", None),
                  "impacted_users": ("user", None, None, None), "impacted_countries_top": ("country", None, "count", None),
                  "top_signin_fail_ips": ("ip", None, "fails", "users"), "top_signin_fail_users": ("user", None, "fails", "ips"),
                  "report_fail_ips": ("ip", None, "fails", None), "report_fail_users": ("user", None, "fails", None),
                  "signin_by_day": ("date", None, "count", None), "ual_by_day": ("date", None, "count", None),
                  "findings_by_day": ("date", None, "count", None), "signin_heatmap_dow_hour": ("dow", "hour", "count", None),
                  "kpis": (None, None, "total_findings", "impacted_ips"), "risk_score": ("risk_label", None, "risk_score", None)}
        out = None
        for name, columns in shapes.items():
            texts = [(F.col(c).cast("string") if c else F.lit("")) for c in columns[:2]]
            values = [(F.col(c).cast("long") if c else F.lit(0).cast("long")) for c in columns[2:]]
            own = tables[name].select(F.lit(name).alias("pivot"), *[x.alias(n) for x, n in zip([*texts, *values], ("k1", "k2", "v1", "v2"))])
            out = own if out is None else out.unionByName(own)
        return out
    return run


def report_tables_sql(all_findings: str, score: str, finding_day: str, day: str, dash: str) -> str:
    """The same in SQL, pivot by pivot."""
    def part(name: str, select: str) -> str:
        return f"SELECT '{name}' AS pivot, * FROM ({select})"

    def fails(key: str, other: str, name: str) -> str:
        return part(name, f"SELECT {key} AS k1, '' AS k2, CAST(sum(CASE WHEN {dash} THEN 1 ELSE 0 END) AS BIGINT) AS v1, count(DISTINCT {other}) AS v2 "
                          f"FROM signin WHERE {key} != '' GROUP BY 1 ORDER BY v1 DESC, v2 DESC, k1 LIMIT {K.TOP_DASH_FAIL}")

    def strict(key: str, name: str) -> str:
        return part(name, f"SELECT {key} AS k1, '' AS k2, count(*) AS v1, CAST(0 AS BIGINT) AS v2 FROM signin WHERE {key} != '' AND ts_epoch IS NOT NULL "
                          f"AND {O.sql_failure()} GROUP BY 1 ORDER BY v1 DESC, k1 LIMIT {K.TOP_FAIL}")

    def count(name: str, key: str, source: str, tail: str = "") -> str:
        return part(name, f"SELECT {key} AS k1, '' AS k2, count(*) AS v1, CAST(0 AS BIGINT) AS v2 FROM {source} GROUP BY 1 {tail}")

    label = "CASE WHEN s >= 85 THEN 'CRITICAL' WHEN s >= 60 THEN 'HIGH' WHEN s >= 30 THEN 'MEDIUM' ELSE 'LOW' END"
    parts = [
        count("severity_counts", "lower(severity)", "f_all"), count("category_top", "category", "f_all", f"ORDER BY v1 DESC, k1 LIMIT {K.TOP_CATEGORIES}"),
        part("impacted_users", "SELECT DISTINCT \"user\" AS k1, '' AS k2, CAST(0 AS BIGINT) AS v1, CAST(0 AS BIGINT) AS v2 FROM f_all WHERE \"user\" != ''"),
        count("impacted_countries_top", "country", "f_all WHERE country != ''", f"ORDER BY v1 DESC, k1 LIMIT {K.TOP_COUNTRIES}"),
        fails("ip", '"user"', "top_signin_fail_ips"), fails('"user"', "ip", "top_signin_fail_users"),
        strict("ip", "report_fail_ips"), strict('"user"', "report_fail_users"),
        count("signin_by_day", day, "signin WHERE ts_epoch IS NOT NULL"), count("ual_by_day", day, "ual WHERE ts_epoch IS NOT NULL"),
        count("findings_by_day", finding_day, "f_all WHERE timestamp != ''"),
        part("signin_heatmap_dow_hour", """SELECT CAST(g.dow AS VARCHAR) AS k1, CAST(g.hour AS VARCHAR) AS k2, coalesce(c.count, 0) AS v1, CAST(0 AS BIGINT) AS v2
FROM (SELECT d AS dow, h AS hour FROM range(7) t1(d), range(24) t2(h)) g
LEFT JOIN (SELECT dayofweek(make_timestamp(ts_epoch * 1000000)) AS dow, hour(make_timestamp(ts_epoch * 1000000)) AS hour,
  count(*) AS count FROM signin WHERE ts_epoch IS NOT NULL GROUP BY 1, 2) c ON c.dow = g.dow AND c.hour = g.hour"""),
        part("kpis", "SELECT '' AS k1, '' AS k2, count(*) AS v1, count(DISTINCT CASE WHEN ip != '' THEN ip END) AS v2 FROM f_all"),
        part("risk_score", f"SELECT {label} AS k1, '' AS k2, s AS v1, CAST(0 AS BIGINT) AS v2 FROM (SELECT {score} AS s FROM f_all)"),
    ]
    return O.with_views_rec(all_findings, select="\nUNION ALL ".join(parts))


def compressed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", compress_text("text", K.REPORT_TEXT_MAX).alias("short"))


COMPRESSED_SQL = (f"SELECT doc_id, CASE WHEN length(text) > {K.REPORT_TEXT_MAX} THEN concat(substr(text, 1, {K.REPORT_TEXT_MAX}), '… (+', "
                  f"length(text) - {K.REPORT_TEXT_MAX}, ' chars)') ELSE coalesce(text, '') END AS short FROM documents")
