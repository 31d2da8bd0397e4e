"""Mixing sources to target weights by entropy balancing.

Among document rates r >= 0 with sum(size x r) = target in each source, the
ones nearest to 1 in relative entropy, weighted by tokens, are exponentials of
one multiplier per source.  Documents of a source share their tilt, so one
aggregation gives the sums that Newton steps on the convex dual need, and the
steps run on the table of sources.  Rates become whole
copies by systematic rounding along the sizes of a source, and the words that
rounding leaves over or short are moved by one more or less copy of documents
that fit into them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import documents, materialise, shuffle_partitions

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
SPACE_PATTERN = "[\\x20\\x09-\\x0D]+"
NEWTON_STEPS, MENDING_STEPS = 12, 4
#: Steps of the size scale per doubling, along which documents are ordered before rounding.
SIZE_STEPS = 8


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_PATTERN, -1), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): weights by code point order (null last), capped at ``most`` times the size.

    The level at which no more source is capped comes from one running sum
    over the sources in the order in which they reach their cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # a row per source
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights))
    per = per.select("source", "source_size", weight.alias("weight"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    per = per.withColumn("goal", share * F.sum("source_size").over(whole)) \
        .withColumn("level", (F.col("goal") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
                    / F.sum("weight").over(rest))
    capped = F.col("level") * F.col("weight") >= most * F.col("source_size")
    per = per.withColumn("last", F.max(F.when(~capped, F.col("level"))).over(whole))
    return per.select("source", "source_size", F.when(capped | F.col("last").isNull(), most * F.col("source_size")).otherwise(
        F.col("weight") * F.col("last")).cast("double").alias("target"))


def balance(goals: DataFrame, steps: int = NEWTON_STEPS, tolerance: float = 1e-12) -> DataFrame:
    """(of, source_size, target, multiplier): Newton steps on the dual source_size x exp(multiplier) - target x multiplier.

    A step is cut to 1, so that it never overshoots far; sums are of whole
    numbers, so that reruns agree bit by bit.
    """
    now = goals.select(F.col("source").alias("of"), "source_size", "target", F.lit(0.0).alias("multiplier"))
    for _ in range(steps):
        mass = F.col("source_size") * F.exp("multiplier")  # gradient: mass - target; curvature: mass
        gap = F.when(F.col("source_size") > 0, (F.col("target") - mass) / mass).otherwise(0.0)
        now = materialise(now.select("of", "source_size", "target", (F.col("multiplier") + F.greatest(
            F.lit(-1.0), F.least(F.lit(1.0), gap))).alias("multiplier"), F.abs(gap).alias("off")), "dual")
        if (now.agg(F.max("off")).first()[0] or 0.0) <= tolerance:
            break
    return now.select("of", "source_size", "target", "multiplier")


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key): a narrow row per document; the key finds its row again."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), _key())


def _key() -> Column:
    return F.xxhash64("doc_id", F.col("source").cast("string"), "text").alias("key")


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target, rate, copies) per key of the narrow table ``docs`` of :func:`sized`.

    Rows that repeat a document share its key and its number of copies.  A
    null text has size 0, a null source is the last source.  Documents without
    words change no count.  An empty table gives none.
    """
    buckets = max(8, 2 * shuffle_partitions(docs.sparkSession))
    units = docs.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"))
    solved = materialise(balance(materialise(targets(docs, weights, share, most), "targets")).withColumn(
        "rate", F.least(F.lit(float(most)), F.exp("multiplier"))).drop("multiplier"), "rates")
    same = F.col("source").eqNullSafe(F.col("of"))
    ordered = materialise(units.withColumn("grade", F.floor(SIZE_STEPS * F.log2(F.col("size") + 1)).cast("int"))
                          .withColumn("bucket", F.pmod("key", F.lit(buckets)).cast("int")), "units")
    counted = ordered.groupBy("source", "grade", "bucket").agg(F.count("*").alias("n"))
    along = Window.partitionBy("source").orderBy("grade", "bucket")  # a row per step of sizes and bucket
    base = counted.select(F.col("source").alias("of"), F.col("grade").alias("g"), F.col("bucket").alias("b"),
                          (F.sum("n").over(along) - F.col("n")).alias("base")).join(
        solved.withColumnRenamed("of", "s"), F.col("of").eqNullSafe(F.col("s"))).drop("s")
    inside = F.row_number().over(Window.partitionBy("source", "grade", "bucket").orderBy("size", "key")) - 1
    at = F.col("base") + F.col("inside")
    dealt = materialise(
        ordered.withColumn("inside", inside).join(base, same & (F.col("grade") == F.col("g")) & (F.col("bucket") == F.col("b")))
        .select("key", "source", "size", "grade", "bucket", "source_size", "target", "rate", (F.floor((at + 1) * F.col("rate") + 0.5)
                - F.floor(at * F.col("rate") + 0.5)).cast("long").alias("copies")), "dealt")
    for _ in range(MENDING_STEPS):
        dealt = _mended(dealt, int(most))
    return dealt.select("key", "source_size", "target", "rate", "copies")


def _mended(dealt: DataFrame, most: int) -> DataFrame:
    """Adds or takes one copy of as many documents as fit into the words missing or too many, large ones first.

    Running sums per bucket and over buckets tell each document what the
    larger ones before it take, so no task sees a whole source.
    """
    off = materialise(dealt.groupBy("source").agg((F.first("target") - F.sum(F.col("copies") * F.col("size"))).alias("off"))
                      .select(F.col("source").alias("of"), "off"), "off")
    can = F.when(F.col("off") > 0, F.col("copies") < most).otherwise(F.col("copies") > 0)
    fit = dealt.join(F.broadcast(off) if off.count() <= 10_000 else off, F.col("source").eqNullSafe(F.col("of"))).where(
        can & (F.col("size") > 0) & (F.col("size") <= F.abs("off"))).select("key", "source", "size", "grade", "bucket", "off")
    along = Window.partitionBy("source").orderBy(F.desc("grade"), "bucket")  # a row per step of sizes and bucket
    base = fit.groupBy("source", "grade", "bucket").agg(F.sum("size").alias("words")).select(
        F.col("source").alias("s"), F.col("grade").alias("g"), F.col("bucket").alias("b"),
        (F.sum("words").over(along) - F.col("words")).alias("base"))
    inside = F.sum("size").over(Window.partitionBy("source", "grade", "bucket").orderBy(F.desc("size"), "key")
                                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    pick = fit.withColumn("inside", inside).join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("grade") == F.col("g"))
                                                 & (F.col("bucket") == F.col("b"))).where(
        F.col("base") + F.col("inside") <= F.abs("off")).select(F.col("key").alias("k"), F.signum("off").cast("long").alias("by"))
    return materialise(dealt.join(pick, F.col("key") == F.col("k"), "left")
                       .withColumn("copies", F.col("copies") + F.coalesce("by", F.lit(0))).drop("k", "by"), "dealt")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """The mixture: each row of ``docs``, all columns unchanged, as often as it is taken (0 to ``most`` times)."""
    found = copies(materialise(sized(docs), "sized"), weights, share, most)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _key().alias("_key"))
    taken = own.join(found.where("copies > 0").select(F.col("key").alias("_of"), F.col("copies").alias("_copies")),
                     F.col("_key") == F.col("_of"))
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("_row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: 150 percent of their words, shared 3, 1, 2 over the sources, none above twice its size."""
    narrow = materialise(sized(documents(spark, sf_dir)), "sized")
    found = copies(narrow).select(F.col("key").alias("of"), "source_size", "target", "rate", "copies")
    return narrow.join(found, F.col("key") == F.col("of")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")
