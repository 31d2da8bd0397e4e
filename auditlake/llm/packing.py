"""Packing by cutting-stock column generation over a histogram of lengths.

Whole sequences' worth of a long document become sequences of their own; what
remains of it has a length class (rounded up to ``GRAIN`` tokens).  The
histogram of classes, as large as the sequence length allows and not larger
with more documents, is a cutting-stock problem: a linear program over
patterns (how many of each class fill one sequence), whose columns are priced
by a knapsack dynamic program.  Rounded-down pattern counts are then dealt to
documents by their rank within the class, and the few left over by rounding
are placed by first fit.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditlake.llm.common import documents, joined_id, materialise, python_ready, shuffle_partitions, split_id
from auditlake.llm.tokens import default_path, encode_column

SEQUENCE, GRAIN, END_ID = 2048, 4, 1


def knapsack(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best value, and how often to take each item, within ``capacity``."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    fits = np.searchsorted(s, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        k = fits[room]
        best[room], pick[room] = best[room - 1], -1
        if k:
            got = v[:k] + best[room - s[:k]]
            j = int(np.argmax(got))
            if got[j] > best[room] + 1e-12:
                best[room], pick[room] = got[j], j
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
        else:
            counts[order[pick[room]]] += 1
            room -= int(s[pick[room]])
    return float(best[capacity]), counts


def first_fit(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns (counts per class, times) that fill one sequence after the other with the largest classes that fit."""
    left, found = demand.astype(np.int64).copy(), []
    while left.any():
        counts, room = np.zeros(len(sizes), np.int64), capacity
        for i in np.argsort(-sizes, kind="stable"):
            n = min(int(left[i]), room // int(sizes[i]))
            counts[i], room = n, room - n * int(sizes[i])
        used = counts > 0
        times = max(1, int((left[used] // counts[used]).min()))
        left -= counts * times
        found.append((counts, times))
    return found


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 5e-4,
                      rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each (fractions), with sum(times x pattern) = demand.

    Revised simplex: the basis has one pattern per class.  Pricing stops when
    the bound that the duals prove is within ``gap`` of the present solution.
    """
    m = len(sizes)
    patterns = np.diag(capacity // sizes).astype(float)
    inverse = np.diag(1.0 / (capacity // sizes))
    times = inverse @ demand
    start = [c for c, _ in first_fit(sizes, demand, capacity)]
    for step in range(rounds):
        duals = inverse.sum(axis=0)
        if start:
            counts = start.pop().astype(float)
            value = float(duals @ counts)
        else:
            value, counts = knapsack(sizes, np.maximum(duals, 0), capacity)
            counts = counts.astype(float)
            if value <= 1 + 1e-9 or times.sum() - float(np.maximum(duals, 0) @ demand) / value <= gap * times.sum():
                break
            value = float(duals @ counts)
        if value <= 1 + 1e-9:
            continue
        enter = inverse @ counts
        up = enter > 1e-9
        if not up.any():
            continue
        ratio = np.full(m, np.inf)
        ratio[up] = np.maximum(times[up], 0) / enter[up]
        out = int(np.argmin(ratio))
        times = times - ratio[out] * enter
        times[out] = ratio[out]
        patterns[:, out] = counts
        pivot = inverse[out] / enter[out]
        inverse -= np.outer(enter, pivot)
        inverse[out] = pivot
        if step % 400 == 399:  # keep rounding errors from adding up
            inverse = np.linalg.inv(patterns)
            times = inverse @ demand
    return [(patterns[:, i].round().astype(np.int64), float(max(0.0, times[i]))) for i in range(m)]


def plan_slots(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> pd.DataFrame:
    """(size, rank, copies, sequence, slot): ranks rank.. of a class go to sequences sequence.., place ``slot`` there."""
    if not len(sizes):
        return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("size", "rank", "copies", "sequence", "slot")})
    left, used = demand.astype(np.int64).copy(), []
    for counts, times in column_generation(sizes, demand.astype(float), capacity):
        hit = counts > 0
        whole = min(int(np.floor(times + 1e-6)), int((left[hit] // counts[hit]).min())) if hit.any() else 0
        if whole > 0:
            left -= counts * whole
            used.append((counts, whole))
    used += first_fit(sizes, left, capacity)
    rows, rank, sequence = [], np.zeros(len(sizes), np.int64), 0
    for counts, times in used:
        slot = 0
        for i in np.flatnonzero(counts):
            for _ in range(int(counts[i])):
                rows.append((int(sizes[i]), int(rank[i]), times, sequence, slot))
                rank[i] += times
                slot += 1
        sequence += times
    return pd.DataFrame(rows, columns=["size", "rank", "copies", "sequence", "slot"])


def measured(docs: DataFrame, tokenizer: str, end_id: int, sequence: int) -> DataFrame:
    """(doc_id, has_id, doc_tokens, crcs): tokens of each document with its end id and the crc32 of each piece cut at ``sequence``."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        for b in batches:
            n, crcs = [], []
            for raw in encode_column(b["text"], tokenizer):
                raw += end
                n.append(len(raw) // 4)
                crcs.append([zlib.crc32(raw[at:at + 4 * sequence]) for at in range(0, len(raw), 4 * sequence)])
            yield pd.DataFrame({"doc_id": b["doc_id"], "has_id": b["has_id"], "doc_tokens": n, "crcs": crcs})

    return split_id(docs, "text").mapInPandas(run, "doc_id long, has_id boolean, doc_tokens long, crcs array<long>")


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, sequence: int = SEQUENCE,
         grain: int = GRAIN) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Every row of ``docs`` is packed, repeated ones too; a null or empty text is
    its end id alone; an empty table gives no pieces.  A sequence shorter than
    ``sequence`` tokens is to be padded.  Ranks within a class are counted per
    bucket of documents and added up over buckets, so no task sees a whole class.
    """
    spark = docs.sparkSession
    python_ready(spark)
    buckets = max(8, 2 * shuffle_partitions(spark))
    grains = -(-sequence // grain)
    rest = F.col("doc_tokens") % sequence
    each = materialise(
        measured(docs, tokenizer or default_path(), end_id, sequence)
        .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "has_id", "doc_tokens", "crcs"), F.lit(buckets)).cast("int"))
        .withColumn("full", F.floor(F.col("doc_tokens") / sequence).cast("long"))
        .withColumn("size", F.ceil(rest / grain).cast("int")), "measured")
    totals = materialise(each.groupBy("bucket", "size").agg(F.count("*").alias("n"), F.sum("full").alias("full")), "totals")
    histogram = totals.where("size > 0").groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").toPandas()  # one row per class
    slots = plan_slots(histogram["size"].to_numpy(np.int64), histogram["n"].to_numpy(np.int64), grains)
    packed = int((slots["sequence"] + slots["copies"]).max()) if len(slots) else 0

    by_size, by_bucket = Window.partitionBy("size").orderBy("bucket"), Window.orderBy("bucket")
    rank_base = totals.select("size", "bucket", (F.sum("n").over(by_size) - F.col("n")).alias("rank_base"))
    full_base = totals.groupBy("bucket").agg(F.sum("full").alias("full")).select(
        "bucket", (F.sum("full").over(by_bucket) - F.col("full") + packed).alias("full_base"))  # a row per bucket
    base = rank_base.join(full_base, "bucket").withColumnsRenamed({"size": "size_of", "bucket": "bucket_of"})
    order = ["has_id", "doc_id", "doc_tokens", "crcs"]
    within = Window.partitionBy("bucket").orderBy(*order)
    ranked = each.withColumn("in_class", F.row_number().over(Window.partitionBy("bucket", "size").orderBy(*order)) - 1) \
        .withColumn("before", F.sum("full").over(within.rowsBetween(Window.unboundedPreceding, -1)))
    ranked = ranked.join(base, (F.col("bucket") == F.col("bucket_of")) & (F.col("size") == F.col("size_of"))).select(
        "doc_id", "has_id", "doc_tokens", "crcs", "full", "size", (F.col("rank_base") + F.col("in_class")).alias("rank"),
        (F.col("full_base") + F.coalesce("before", F.lit(0))).alias("full_at"))

    slots = slots.sort_values(["size", "rank"])
    keys = slots["size"].to_numpy(np.int64) * (1 << 40) + slots["rank"].to_numpy(np.int64)
    start, seq, place = (slots[c].to_numpy(np.int64) for c in ("rank", "sequence", "slot"))

    def deal(batches):
        for b in batches:
            n = b["doc_tokens"].to_numpy(np.int64)
            at = np.searchsorted(keys, b["size"].to_numpy(np.int64) * (1 << 40) + b["rank"].to_numpy(np.int64), side="right") - 1
            to = np.where(at >= 0, seq[at] + b["rank"].to_numpy(np.int64) - start[at], 0) if len(keys) else np.zeros(len(n), np.int64)
            slot = place[at] if len(keys) else np.zeros(len(n), np.int64)
            reps = np.array([len(c) for c in b["crcs"]], np.int64)
            row = np.repeat(np.arange(len(n)), reps)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps)
            length = np.minimum(sequence, n[row] - piece * sequence)
            whole = length == sequence
            yield pd.DataFrame({
                "doc_id": b["doc_id"].to_numpy(np.int64)[row], "has_id": b["has_id"].to_numpy(bool)[row],
                "start": piece * sequence, "length": length,
                "ids_crc32": np.concatenate(b["crcs"].to_numpy()) if len(row) else np.zeros(0, np.int64), "doc_tokens": n[row],
                "sequence_id": np.where(whole, b["full_at"].to_numpy(np.int64)[row] + piece, to[row]),
                "slot": np.where(whole, 0, slot[row])})

    pieces = ranked.mapInPandas(deal, "doc_id long, has_id boolean, start long, length long, ids_crc32 long, doc_tokens long, "
                                      "sequence_id long, slot long")
    along = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return pieces.select(joined_id(), "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(along), F.lit(0)).cast("long").alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(documents(spark, sf_dir))
