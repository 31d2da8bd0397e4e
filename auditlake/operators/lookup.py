"""Small-dimension lookups: file sha256 and error hints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_file_sha(df: DataFrame, files: DataFrame | None, key: str = "file_id") -> DataFrame:
    """Left equi-lookup ``file_id -> sha256`` (``join_file_sha``); '' when unknown."""
    if files is None:
        return df.withColumn("sha256", F.lit(""))
    # One row per input file.  No static hint: AQE measures the file side at
    # runtime and turns the join into a broadcast when it is below
    # spark.sql.adaptive.autoBroadcastJoinThreshold, else keeps the shuffle join.
    dim = files.select(F.col("file_id").alias("_sha_fid"), F.col("sha256").alias("_sha"))
    out = df.join(dim, df[key] == dim["_sha_fid"], "left")
    return out.withColumn("sha256", F.coalesce(F.col("_sha"), F.lit(""))).drop("_sha_fid", "_sha")
