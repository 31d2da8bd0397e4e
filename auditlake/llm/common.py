"""Helpers shared by the training-data operators: tables in the shared folder, words, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import checkpoint_dir, ship_package

#: Words as every contract of this subpackage defines them.
WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole ``documents`` table."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def python_ready(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers."""
    ship_package(spark)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts the lineage at a table that every executor can read, so losing an
    executor repeats only the stage that was running.  The JVM is then asked
    to collect garbage, which lets Spark delete the shuffle files of the
    finished job instead of keeping them for the rest of the query.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    del df
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that no later step reads."""
    spark = df.sparkSession
    for f in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def split_id(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, has_id, others...): null ids as 0 and false, so that pandas batches keep whole numbers."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNotNull().alias("has_id"), *others)


def joined_id() -> Column:
    """The doc_id that :func:`split_id` took apart."""
    return F.when(F.col("has_id"), F.col("doc_id")).alias("doc_id")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame, a: str = "src", b: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of ``edges``; component is the smallest node reachable.

    Alternating large-star and small-star contraction.  Each half round is one
    partial aggregation (the smallest neighbour of a node) and one join of two
    written tables, so that adaptive execution can split the join of a node
    with very many neighbours.  Self loops and repeated edges are harmless.
    The number of rounds grows with the logarithm of the longest chain.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    cur = materialise(edges.select(hi, lo).where("u != v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = materialise(both.groupBy("u").agg(F.min("v").alias("m"))
                            .select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "star")
        large = materialise(both.join(small, F.col("u") == F.col("k")).where("v > u")
                            .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "edges")
        discard(small)
        discard(cur)
        small = materialise(large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k"), "star")
        tied = large.join(small, F.col("u") == F.col("k")).where("v != m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        cur = materialise(tied.union(small.select(F.col("k").alias("u"), F.col("m").alias("v")))
                          .where("u != v").distinct(), "edges")
        discard(small)
        discard(large)
        now = cur.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if before == (now["n"], now["h"]):
            break
        before = (now["n"], now["h"])
    else:
        raise RuntimeError("connected_components did not settle; raise max_rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
