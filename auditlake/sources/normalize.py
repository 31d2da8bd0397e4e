"""The normalisation that every source shares: missing text as '', derived error code, ISO time and operation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonfn import operation_fallback
from ..functions.predicates import error_code
from ..functions.text import nz
from ..functions.timefmt import iso_from_epoch
from ..schema import SIGNIN_COLUMNS, UAL_COLUMNS

_NUMBERS = ("file_id", "rownum", "ts_epoch")


def _finish(df: DataFrame, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    there = set(df.columns)
    return df.select(*keep, *[F.col(c) if c in _NUMBERS else (nz(c) if c in there else F.lit("")).alias(c)
                              for c in columns if c not in keep and (c in there or c != "file_id")])


def normalize_signin(raw: DataFrame, *keep: str) -> DataFrame:
    """Canonical sign-in columns (``norm_signin``) of raw ones; ``keep`` columns stay in front."""
    df = raw.withColumn("error_code", error_code("result_type")).withColumn("ts_iso", iso_from_epoch("ts_epoch"))
    return _finish(df, SIGNIN_COLUMNS, keep)


def normalize_ual(raw: DataFrame, *keep: str) -> DataFrame:
    """Canonical audit columns (``norm_ual``) with the AuditData operation fallback."""
    df = raw.withColumn("operation", operation_fallback("operation", "auditdata")).withColumn("ts_iso", iso_from_epoch("ts_epoch"))
    return _finish(df, UAL_COLUMNS, keep)
