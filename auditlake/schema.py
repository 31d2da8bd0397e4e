"""Canonical table schemas and the finding record builder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.text import nz

S = T.StringType()
L = T.LongType()

FILES_SCHEMA = T.StructType([
    T.StructField("file_id", L), T.StructField("path", S), T.StructField("name", S), T.StructField("family", S),
    T.StructField("sha256", S), T.StructField("rows", L), T.StructField("delimiter", S),
    T.StructField("skiprows", T.IntegerType()), T.StructField("start_epoch", L), T.StructField("end_epoch", L),
    T.StructField("columns", T.ArrayType(S)),
    T.StructField("error", S),
])

SIGNIN_COLUMNS = [
    "file_id", "rownum", "ts_epoch", "ts_iso", "user", "ip", "app", "client_app", "user_agent", "device_id",
    "correlation_id", "result_type", "error_code", "failure_reason", "status", "risk_level", "risk_state",
    "risk_detail", "country", "state", "city", "raw_json",
]
SIGNIN_SCHEMA = T.StructType(
    [T.StructField(c, L if c in ("file_id", "rownum", "ts_epoch") else S) for c in SIGNIN_COLUMNS])

UAL_COLUMNS = [
    "file_id", "rownum", "ts_epoch", "ts_iso", "user", "ip", "operation", "workload", "record_type", "object_id",
    "auditdata", "raw_json",
]
UAL_SCHEMA = T.StructType(
    [T.StructField(c, L if c in ("file_id", "rownum", "ts_epoch") else S) for c in UAL_COLUMNS])

FINDING_COLUMNS = [
    "finding_id", "severity", "category", "title", "timestamp", "user", "ip", "country", "file", "rownum",
    "sha256", "details", "evidence_json",
]
FINDING_SCHEMA = T.StructType([T.StructField(c, S) for c in FINDING_COLUMNS])

TIMELINE_COLUMNS = ["ts", "epoch", "source", "user", "ip", "action", "detail", "ref"]


def _lit_or(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.lit(c)


def finding_columns(*, finding_id: Column, severity, category, title, timestamp,
                    user="", ip="", country="", file="multiple", rownum="", sha256="", details="",
                    evidence: Column | None = None) -> list[Column]:
    """The 13 finding fields (all strings, never NULL), in order."""
    ev = F.to_json(evidence) if evidence is not None else F.lit("{}")
    cols = {
        "finding_id": finding_id, "severity": _lit_or(severity), "category": _lit_or(category),
        "title": _lit_or(title), "timestamp": _lit_or(timestamp), "user": _lit_or(user), "ip": _lit_or(ip),
        "country": _lit_or(country), "file": _lit_or(file), "rownum": _lit_or(rownum),
        "sha256": _lit_or(sha256), "details": _lit_or(details), "evidence_json": ev,
    }
    return [nz(cols[c]).alias(c) for c in FINDING_COLUMNS]


def exploded_findings(rows: DataFrame, items: list[tuple[int, Column, list[Column]]]) -> DataFrame:
    """A finding with its ``detector_no`` for each item (detector number, condition, finding columns) that a row meets.

    Rows are exploded by the numbers of the items that they meet, and the
    findings built behind that, column by column, so that those nobody asks
    for are not built.
    """
    met = F.array_remove(F.array(*[F.when(cond, F.lit(i)).otherwise(F.lit(-1)) for i, (_, cond, _) in enumerate(items)]), -1)

    def of_item(values: list) -> Column:
        *others, last = values
        out = None
        for i, v in enumerate(others):
            out = F.when(F.col("_item") == i, v) if out is None else out.when(F.col("_item") == i, v)
        return last if out is None else out.otherwise(last)

    return rows.withColumn("_item", F.explode(met)).select(
        *[of_item([columns[k] for *_, columns in items]).alias(name) for k, name in enumerate(FINDING_COLUMNS)],
        of_item([F.lit(no) for no, *_ in items]).alias("detector_no"))


def finding(df: DataFrame, **kw) -> DataFrame:
    """Project ``df`` onto the 13 finding columns with one flat projection, so a top-k
    (``orderBy().limit()``) under it still plans as ``TakeOrderedAndProject``."""
    return df.select(*finding_columns(**kw))


def empty_findings(spark) -> DataFrame:
    return spark.createDataFrame([], FINDING_SCHEMA)
