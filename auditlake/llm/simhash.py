"""SimHash near duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments.  If two fingerprints differ in
at most four bits, the two segments with the fewest differences hold at most
(1, 1) or (0, 2) of them.  For (1, 1) each segment is decoded to the index of
its codeword; one side carries the pair of home indices, the other one the
pairs of all codewords within four bits, among which the home of any word one
bit away must be.  For (0, 2) one segment is the same bit by bit and is itself the key.
Equal keys join, the bit distance is verified inside the join, and the
links become components.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import golay
from auditlake.llm.common import connected_components, documents, joined_id, materialise, python_ready, split_id

_WORD = re.compile("[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Bits of each segment (low bit, width); a segment is read as a 23-bit word with zeros above it.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SEED = 42
#: Hashes unpacked to bits at once, to bound memory on very long texts.
BLOCK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """64-bit SimHash of the shingles of ``width`` words (fewer words: the whole sequence; none: 0)."""
    words = _WORD.findall((text or "").translate(_LOWER))
    if not words:
        return 0
    encoded = [w.encode("utf-8", "surrogatepass") for w in words]
    joined = b" ".join(encoded)
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    digest, n, ones = xxhash.xxh64_intdigest, len(words) - width + 1, np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        to = min(n, at + BLOCK)
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(
            starts[at:to].tolist(), ends[at + width - 1:to + width - 1].tolist())), "<u8", to - at)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def row_key() -> Column:
    """Finds a row again; rows that repeat both doc_id and text share it."""
    return F.xxhash64("doc_id", "text").alias("row")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, row, fp): one row per input row; fp is the fingerprint as a signed long."""
    python_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "has_id": b["has_id"], "row": b["row"], "fp": fp.view(np.int64)})

    return split_id(docs, row_key(), "text").mapInPandas(run, "doc_id long, has_id boolean, row long, fp long").select(
        joined_id(), "row", "fp")


def _keyed(fps: DataFrame, probe: bool) -> DataFrame:
    """(key, fp): the home keys of each fingerprint, or the keys that it looks up (``probe``)."""

    def run(batches):
        for b in batches:
            fp = b["fp"].to_numpy(np.int64)
            parts = [(fp >> low) & ((1 << width) - 1) for low, width in SEGMENTS]
            near = [golay.nearby(p) if probe else golay.home(p)[:, None] for p in parts]
            for i in range(3):
                j = (i + 1) % 3
                pair = np.where((near[i][:, :, None] >= 0) & (near[j][:, None, :] >= 0),
                                (near[i][:, :, None] << 12) | near[j][:, None, :], -1).reshape(len(fp), -1)
                keep = pair >= 0
                yield pd.DataFrame({"key": pair[keep] | (i << 24), "fp": np.repeat(fp, keep.sum(axis=1))})
                yield pd.DataFrame({"key": parts[i] | ((3 + i) << 24), "fp": fp})

    return fps.select("fp").mapInPandas(run, "key int, fp long")


def links(fps: DataFrame, max_bits: int = 4) -> DataFrame:
    """(src, dst), src < dst: all pairs of distinct fingerprints at ``max_bits`` (4 at most) or fewer differing bits."""
    if not 0 <= max_bits <= 4:
        raise ValueError("the keys guarantee up to four differing bits")
    python_ready(fps.sparkSession)
    at_home, look = _keyed(fps, False), _keyed(fps, True)
    return at_home.alias("h").hint("merge").join(look.alias("p"), (F.col("h.key") == F.col("p.key")) & (F.col("h.fp") < F.col("p.fp")) & (
        F.bit_count(F.col("h.fp").bitwiseXOR(F.col("p.fp"))) <= max_bits)).select(
        F.col("h.fp").alias("src"), F.col("p.fp").alias("dst")).distinct()


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, row, fp, group, component_id) for every row of ``docs``.

    group names the component by its smallest fingerprint; component_id is the
    smallest doc_id in it.  Null texts and texts without words have
    fingerprint 0 and link like any other; rows that repeat a doc_id are kept;
    component_id is null only where no row of the component has a doc_id.  An
    empty table gives an empty result.  Copies share a fingerprint and are
    joined to it once, never paired.
    """
    each = materialise(fingerprints(docs, width), "fingerprints")
    distinct = materialise(each.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    pairs = materialise(links(distinct, max_bits), "links")
    comp = materialise(connected_components(pairs), "components")
    member = distinct.join(comp, distinct.fp == comp.node, "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("group"))
    first = member.groupBy("group").agg(F.min("first").alias("component_id"))
    ids = materialise(member.join(first, "group").select(F.col("fp").alias("of"), "group", "component_id"), "ids")
    return each.join(ids, each.fp == ids.of, "left").select("doc_id", "row", "fp", "group", "component_id")


def keep_one(docs: DataFrame, width: int = 4, max_bits: int = 4) -> DataFrame:
    """One row of each component, all columns unchanged: the smallest doc_id, null last; ties go to the smallest row key."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    kept = near_duplicates(docs, width, max_bits).groupBy("group").agg(F.min(place).alias("first")).select(
        F.col("first.row").alias("of"))
    kept = materialise(kept, "kept")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), row_key())
    return own.join(kept, F.col("row") == F.col("of")).dropDuplicates(["row"]).select("_row.*")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near duplicates of all ``documents`` (shingles of 4 words, 4 bits)."""
    found = near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
