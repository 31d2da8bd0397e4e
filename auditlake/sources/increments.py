"""Ingest that goes on: batches of new or changed files appended to tables, each batch once.

A batch writes its rows under ``signin/batch=N`` and ``ual/batch=N``, and last
its files under ``files/batch=N``, which is what makes it count; rows of a
batch without files are never read.  A batch that is tried again replaces its
own folders.  A changed file counts with its newest batch, so a table holds
each path once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.positions import with_position
from ..schema import SIGNIN_SCHEMA, UAL_SCHEMA
from ..session import cut_lineage
from .logs import ingest_files

FILES_SCHEMA = ("file_id long, path string, name string, family string, sha256 string, rows long, delimiter string, skiprows int, "
                "start_epoch long, end_epoch long, columns array<string>, encoding string, error string, length long, modified long, "
                "origin string")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def listed(listing: DataFrame) -> DataFrame:
    """(path, name, length, modified) of a ``binaryFile`` listing; file contents are not read."""
    return listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length",
                          F.unix_micros("modificationTime").alias("modified"))


def all_files(spark: SparkSession, tables: str) -> DataFrame:
    """Files of all batches (FILES_SCHEMA, batch); empty before the first."""
    if not _exists(spark, f"{tables}/files"):
        return spark.createDataFrame([], f"{FILES_SCHEMA}, batch long")
    return spark.read.schema(f"{FILES_SCHEMA}, batch long").parquet(f"{tables}/files")


def current_files(spark: SparkSession, tables: str) -> DataFrame:
    """The newest entry of each path."""
    newest = Window.partitionBy("path").orderBy(F.desc("batch"))
    return all_files(spark, tables).withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


def current_tables(spark: SparkSession, tables: str) -> dict:
    """``files``, ``signin`` and ``ual`` as of the last batch that counts; replaced files and their rows are left out."""
    files = current_files(spark, tables)
    live = files.select(F.col("batch").alias("_batch"), F.col("file_id").alias("_file"))
    out = {"files": files.drop("batch", "origin", "length", "modified")}
    for name, schema in (("signin", SIGNIN_SCHEMA), ("ual", UAL_SCHEMA)):
        if _exists(spark, f"{tables}/{name}"):
            rows = spark.read.parquet(f"{tables}/{name}")
            rows = rows.join(live, (F.col("batch") == F.col("_batch")) & (F.col("file_id") == F.col("_file")), "left_semi").drop("batch")
        else:
            rows = spark.createDataFrame([], schema)
        out[name] = rows
    return out


def append_batch(spark: SparkSession, listing: DataFrame, tables: str, origin: str | None = None) -> int | None:
    """Ingest the files of ``listing`` (path, name, length, modified) that are new or changed; the number of the batch, None without any.

    With ``origin`` a batch that was tried before, or has been finished,
    keeps its number and its file ids, and is written anew with its own files.
    """
    known = all_files(spark, tables)
    before = known if origin is None else known.where(F.coalesce(F.col("origin") != origin, F.lit(True)))
    again = None if origin is None else known.where(F.col("origin") == origin).agg(F.min("batch")).first()[0]
    if again is not None:
        before = before.where(F.col("batch") < again)
    top = before.agg(F.max("batch").alias("batch"), F.max("file_id").alias("file_id")).first()
    batch = again if again is not None else (known.agg(F.max("batch")).first()[0] or 0) + 1
    newest = Window.partitionBy("path").orderBy(F.desc("batch"))
    seen = before.withColumn("_n", F.row_number().over(newest)).where("_n = 1").select("path", "length", "modified")
    fresh = listing.join(seen, ["path", "length", "modified"], "left_anti")
    fresh = with_position(fresh, "path", name="_place").withColumn("file_id", F.col("_place") + F.lit(top["file_id"] or 0))
    fresh = cut_lineage(fresh.select("file_id", "path", "name", "length", "modified"))
    if fresh.isEmpty():
        return None
    got = ingest_files(fresh.drop("modified"))
    for name in ("signin", "ual"):
        got[name].write.mode("overwrite").parquet(f"{tables}/{name}/batch={batch}")
    # the counts of the files come from the rows just written
    stats = None
    for name in ("signin", "ual"):
        own = spark.read.parquet(f"{tables}/{name}/batch={batch}").groupBy("file_id").agg(
            F.count("*").alias("rows"), F.min("ts_epoch").alias("start_epoch"), F.max("ts_epoch").alias("end_epoch"))
        stats = own if stats is None else stats.unionByName(own)
    files = got["described"].join(stats, "file_id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    files = files.join(fresh.select("file_id", "length", "modified"), "file_id").withColumn("origin", F.lit(origin).cast("string"))
    names = [f.split()[0] for f in FILES_SCHEMA.split(", ")]
    files.select(*names).write.mode("overwrite").parquet(f"{tables}/files/batch={batch}")
    return batch


def ingest_new(spark: SparkSession, logdir: str, tables: str) -> int | None:
    """Ingest the files of a folder that ``tables`` lacks or holds in another version; the number of the batch, None without any."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").load(logdir))
    return append_batch(spark, listed(listing), tables)
