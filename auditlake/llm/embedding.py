"""Embedding near duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the principal axes is learned on a bounded sample so that signs
of the rotated coordinates are balanced and lose little; every vector becomes
a code of up to 64 such bits.  The code is cut into substrings; each is an
index key, and each vector looks up all keys within some bits of its own, as
many as pairs at the threshold differ by in the sample.
Candidates that agree are cut by their whole code inside the join and then
reranked with the original vectors in double precision.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import connected_components, materialise, python_ready

#: The rotation is fitted on at most so many distinct vectors of a dimension, chosen by hash.
TRAIN_ROWS = 8192
MAX_BITS, SUBSTRING = 64, 16
#: Least and most bits of a substring that a probe flips, and the share of pairs at the threshold that the probes must find.
PROBE_BITS, MOST_PROBE_BITS, FOUND = 2, 6, 0.97


def fit_rotation(x: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (v - mean) @ projection are the code bits of a unit vector v.

    Vectors of fewer dimensions than MAX_BITS get several rotations, learned
    from different starts, so that every code has MAX_BITS bits.
    """
    dim = x.shape[1]
    bits = min(dim, MAX_BITS)
    mean = x.mean(axis=0)
    spread = (x - mean).T @ (x - mean) / max(1, len(x) - 1)
    _, _, axes = np.linalg.svd(spread + 1e-9 * np.eye(dim))
    basis = axes[:bits].T
    v = (x - mean) @ basis
    turns = []
    for start in range(-(-MAX_BITS // bits)):
        turn, _ = np.linalg.qr(np.random.default_rng(7 + start).standard_normal((bits, bits)))
        for _ in range(rounds):
            signs = np.where(v @ turn >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(signs.T @ v)
            turn = (left @ right).T
        turns.append(basis @ turn)
    return mean, np.concatenate(turns, axis=1)[:, :MAX_BITS]


def _vectors(column: pa.Array) -> np.ndarray:
    """Rows of one dimension as doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _substrings(bits: int) -> list[tuple[int, int]]:
    n = -(-bits // SUBSTRING)
    edges = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _keyed(codes: DataFrame, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(key, id, code): one row per substring and flip of up to ``radius`` of its bits."""

    def run(batches):
        for b in batches:
            code, ids = b["code"].to_numpy(np.int64), b["id"].to_numpy(np.int64)
            for t, (low, width) in enumerate(parts):
                flips = np.array([sum(1 << i for i in c) for r in range(min(radius, width) + 1)
                                  for c in itertools.combinations(range(width), r)], dtype=np.int64)
                own = (code >> low) & ((1 << width) - 1)
                for at in range(0, len(own), 2000):
                    key = (own[at:at + 2000, None] ^ flips[None, :]).ravel() | (t << SUBSTRING)
                    yield pd.DataFrame({"key": key, "id": np.repeat(ids[at:at + 2000], len(flips)),
                                        "code": np.repeat(code[at:at + 2000], len(flips))})

    return codes.mapInPandas(run, "key int, id long, code long")


def measured(x: np.ndarray, mean: np.ndarray, projection: np.ndarray, threshold: float) -> tuple[int, int]:
    """(bits that a probe flips, most bits in which the codes of a candidate differ) for pairs at the threshold.

    Each unit vector of the sample ``x`` is paired with one at just that
    cosine, in a random direction, and the near pairs among the first 2,000
    are measured too, as off the centre they differ more; the harder kind
    decides.
    """
    rng = np.random.default_rng(11)
    across = rng.standard_normal(x.shape)
    across -= (across * x).sum(axis=1, keepdims=True) * x
    length = np.linalg.norm(across, axis=1, keepdims=True)
    across = np.divide(across, length, out=np.zeros_like(across), where=length > 1e-9)
    other = threshold * x + math.sqrt(max(0.0, 1 - threshold ** 2)) * across
    code = (x - mean) @ projection >= 0
    some = x[:2000]
    cosine = some @ some.T
    i, j = np.nonzero(np.triu((cosine >= threshold) & (cosine < threshold + (1 - threshold) / 3), 1))
    kinds = [code != ((other - mean) @ projection >= 0)]
    if len(i) >= 30:
        kinds.append(code[i] != code[j])
    bits, p = code.shape[1], math.acos(threshold) / math.pi
    radius, most = PROBE_BITS, math.ceil(bits * p + 3.5 * math.sqrt(bits * p * (1 - p)))
    for flips in kinds:
        least = np.stack([flips[:, low:low + width].sum(axis=1) for low, width in _substrings(bits)], axis=1).min(axis=1)
        radius = max(radius, next((r for r in range(PROBE_BITS, MOST_PROBE_BITS) if (least <= r).mean() >= FOUND), MOST_PROBE_BITS))
        most = max(most, math.ceil(np.quantile(flips.sum(axis=1), 0.999)))
    return radius, most


def _candidates(codes: DataFrame, bits: int, radius: int, most: int) -> DataFrame:
    """(src, dst), src < dst, each once: vectors that share a key and whose codes differ in at most ``most`` bits."""
    parts = _substrings(bits)
    index, look = _keyed(codes, parts, 0).alias("i"), _keyed(codes, parts, radius).alias("p")
    differ = F.col("i.code").bitwiseXOR(F.col("p.code"))
    near = (F.col("i.key") == F.col("p.key")) & (F.col("i.id") < F.col("p.id")) & (F.bit_count(differ) <= most)
    for t, (low, width) in enumerate(parts[:-1]):  # only the first table that finds a pair emits it
        mask = ((1 << width) - 1) << low
        mask -= (1 << 64) if mask >= 1 << 63 else 0
        near &= (F.shiftright("i.key", SUBSTRING) <= t) | (F.bit_count(differ.bitwiseAND(F.lit(mask).cast("long"))) > radius)
    return index.hint("merge").join(look, near).select(F.col("i.id").alias("src"), F.col("p.id").alias("dst"))


def _reranked(pairs: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose cosine, in double precision, is at least ``threshold``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = _vectors(b.column("x")), _vectors(b.column("y"))
                x, y = (v / np.abs(v).max(axis=1, keepdims=True) for v in (x, y))
                cos = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                yield pa.RecordBatch.from_pydict({"src": b.column("src"), "dst": b.column("dst"), "cosine": cos}).filter(
                    pa.array(cos >= threshold))

    half = materialise(pairs.join(vectors.select(F.col("id").alias("src"), F.col("v").alias("x")), "src"), "half")
    both = half.join(vectors.select(F.col("id").alias("dst"), F.col("v").alias("y")), "dst").select("src", "dst", "x", "y")
    return both.mapInArrow(run, "src long, dst long, cosine double")


def similar_classes(vectors: DataFrame, threshold: float = 0.9) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, classes, links) of the vectors (row, vec_id, embedding); ``row`` is a row's own number.

    members: (row, id) of every usable row; classes: (id, least, n, v), a row
    per distinct vector, id the smallest row and least the smallest vec_id with
    it; links: (src, dst, cosine) between classes.  Null or zero vectors and
    those with null or non-finite components are not usable and appear
    nowhere.  Vectors of different dimension never link.  Each dimension has
    its own rotations.
    """
    spark = vectors.sparkSession
    python_ready(spark)
    usable = vectors.select("row", "vec_id", F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.expr("v is not null and exists(v, c -> c != 0) and forall(v, c -> c is not null "
                                             "and not isnan(c) and abs(c) < double('infinity'))"))
    classes = materialise(usable.groupBy("v").agg(F.min("row").alias("id"), F.min("vec_id").alias("least"), F.count("*").alias("n"))
                          .withColumn("dim", F.size("v")), "classes")
    members = usable.join(classes.select(F.col("v").alias("of"), "id"), F.col("v") == F.col("of")).select("row", "id")
    found = None
    for dim in sorted(r["dim"] for r in classes.select("dim").distinct().collect()):
        own = classes.where(F.col("dim") == dim)
        sample = own.orderBy(F.xxhash64("least"), "least", "id").limit(TRAIN_ROWS).select("v").toPandas()["v"]
        sample = _unit(np.stack(sample.to_numpy()))
        mean, projection = fit_rotation(sample)
        bits, (radius, most) = projection.shape[1], measured(sample, mean, projection, threshold)

        def encode(batches, mean=mean, projection=projection):
            for b in batches:
                if b.num_rows:
                    signs = ((_unit(_vectors(b.column("v"))) - mean) @ projection) >= 0
                    full = np.zeros((len(signs), MAX_BITS), dtype=bool)
                    full[:, :signs.shape[1]] = signs
                    code = np.packbits(full, axis=1, bitorder="little").view("<i8").ravel()
                    yield pa.RecordBatch.from_pydict({"id": b.column("id"), "code": code})

        codes = materialise(own.select("id", "v").mapInArrow(encode, "id long, code long"), "codes")
        near = materialise(_candidates(codes, bits, radius, most), "candidates")
        linked = _reranked(near, own.select("id", "v"), threshold)
        found = linked if found is None else found.union(linked)
    if found is None:
        found = spark.createDataFrame([], "src long, dst long, cosine double")
    return members, classes, materialise(found, "links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding).

    Copies of a vector form one class; its links count with the sizes of both
    classes and are never expanded.  Rows that repeat a vec_id, with the same
    or another vector, are rows of their own.  Unusable vectors have no links
    and are their own component; rows with a null vec_id get null and are not
    kept.
    """
    rows = materialise(vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding"), "rows")
    members, classes, links = similar_classes(rows, threshold)
    comp = materialise(connected_components(links), "components")
    least = comp.join(classes.select("id", "least"), F.col("node") == F.col("id")).groupBy("component").agg(F.min("least").alias("first"))
    comp = comp.join(least, "component").select("node", "first")
    ends = links.select("src", "dst").union(links.select("dst", "src"))
    degree = ends.join(classes.select(F.col("id").alias("dst"), "n"), "dst").groupBy("src").agg(F.sum("n").alias("others"))
    per_class = materialise(
        classes.select("id", "least", "n").join(degree, F.col("id") == F.col("src"), "left")
        .join(comp, F.col("id") == F.col("node"), "left")
        .select(F.col("id").alias("of"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
                F.coalesce("first", "least").alias("component_id")), "per_class")
    placed = members.join(per_class, F.col("id") == F.col("of")).select(F.col("row").alias("member"), "n_links", "component_id")
    return rows.select("row", "vec_id").join(placed, F.col("row") == F.col("member"), "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(False)).alias("kept"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near duplicates of all ``embeddings`` at cosine 0.9."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
