"""Token-ID output: texts to ids, in document order, to entropy-coded blocks and back.

A dataset folder holds ``table`` (symbol, count), ``shards`` (shard, tokens)
and ``blocks``, whose rows are blocks of ``rans``: each names its shard and
its first token there, carries its documents, the start states of its lanes,
checkpoints to begin decoding inside, and checksums.  Rows are written by
Spark's Parquet writer, so a lost task or executor leaves no partial file;
any subset of blocks can be decoded anywhere with the shared table.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm import rans
from auditlake.llm.common import discard, documents, joined_id, materialise, python_ready, shuffle_partitions, split_id
from auditlake.llm.tokens import default_path, encode_column
from auditlake.session import checkpoint_dir

END_ID = 0
BLOCK_TOKENS = 1 << 19


def token_rows(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(shard, shard_start, doc_id, has_id, n_tokens, ids, counts): documents in ascending doc_id order over shards.

    ids holds 16-bit numbers where the vocabulary allows it, else 32-bit ones;
    a last row per shard has no document and the shard's symbol counts.  The
    text is range-partitioned before it is tokenised, so that the sampling of
    range boundaries reads the table and never runs the tokeniser.  A null
    doc_id sorts first; a null or empty text has only the end id; rows that
    repeat a doc_id all stay, ordered by their text.
    """
    kind = id_kind(tokenizer)

    def run(batches):
        start, shard, total = 0, None, np.zeros(0, np.int64)
        for b in batches:
            ids = [np.append(np.frombuffer(raw, "<u4"), np.uint32(end_id)).astype(kind) for raw in encode_column(b["text"], tokenizer)]
            n = np.fromiter(map(len, ids), np.int64, len(ids))
            starts = start + np.cumsum(n) - n
            start += int(n.sum())
            for at in range(0, len(ids), 512):
                found = np.bincount(np.concatenate(ids[at:at + 512]))
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[:len(found)] += found
            shard = int(b["shard"].iloc[0]) if len(b) else shard
            yield pd.DataFrame({"shard": b["shard"], "shard_start": starts, "doc_id": b["doc_id"], "has_id": b["has_id"],
                                "n_tokens": n, "ids": [i.tobytes() for i in ids], "counts": None})
        if shard is not None:
            yield pd.DataFrame({"shard": [shard], "shard_start": [start], "doc_id": [0], "has_id": [False], "n_tokens": [0],
                                "ids": [None], "counts": [total.astype("<i8").tobytes()]})

    ordered = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id") \
        .sortWithinPartitions("doc_id", "text")
    return split_id(ordered, "text", F.spark_partition_id().alias("shard")).mapInPandas(
        run, "shard int, shard_start long, doc_id long, has_id boolean, n_tokens long, ids binary, counts binary")


def id_kind(tokenizer: str) -> str:
    from auditlake.llm.tokens import encoder
    return "<u2" if encoder(tokenizer).tokenizer.get_vocab_size() <= 1 << 16 else "<u4"


def _counts(rows: DataFrame) -> DataFrame:
    """(symbol, n) over all documents, from the rows of counts."""
    def run(batches):
        for b in batches:
            for raw in b["counts"]:
                total = np.frombuffer(raw, "<i8")
                hit = np.flatnonzero(total)
                yield pd.DataFrame({"symbol": hit, "n": total[hit]})

    return rows.where("counts is not null").select("counts").mapInPandas(run, "symbol long, n long").groupBy("symbol").agg(
        F.sum("n").alias("n"))


def _table(rows: DataFrame) -> rans.Table:
    """The shared table; it has a row per vocabulary entry at most, whatever the input."""
    got = rows.toPandas()
    return rans.Table(got["symbol"].to_numpy(np.int64), got["n"].to_numpy(np.int64))


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = END_ID,
          block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode all texts of (doc_id, text) into a dataset folder at ``path``."""
    spark = docs.sparkSession
    python_ready(spark)
    tokenizer = tokenizer or default_path()
    kind = id_kind(tokenizer)
    rows = materialise(token_rows(docs, tokenizer, end_id), "token-rows")
    _counts(rows).coalesce(1).write.parquet(f"{path}/table")
    rows.groupBy("shard").agg(F.sum("n_tokens").alias("tokens")).write.parquet(f"{path}/shards")
    shared = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{path}/table")))

    def encode(batches):
        held: list[tuple] = []
        size, shard, following, number = 0, None, None, 0

        def flush():
            ids = np.frombuffer(b"".join(h[3] for h in held), kind)
            raw = rans.encode_block(ids, shared.value, np.array([h[1] for h in held], np.int64),
                                    np.array([h[4] for h in held], bool), np.array([h[2] for h in held], np.int64))
            return pd.DataFrame({"shard": [shard], "shard_start": [held[0][0]], "n_docs": [len(held)],
                                 "n_tokens": [len(ids)], "payload": [raw]})

        for b in batches:
            for own, start, doc, has, n, ids in zip(*(b[c] for c in (
                    "shard", "shard_start", "doc_id", "has_id", "n_tokens", "ids"))):
                if held and (own != shard or start != following or size >= block_tokens):
                    yield flush()
                    held, size = [], 0
                shard, following = own, start + n
                held.append((start, doc, n, ids, has))
                size += n
        if held:
            yield flush()

    rows.where("counts is null").drop("counts").mapInPandas(encode, "shard int, shard_start long, n_docs long, n_tokens long, payload binary") \
        .write.option("compression", "none").parquet(f"{path}/blocks")
    discard(rows)
    shared.unpersist()


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the folder; start counts the ids of all documents before."""
    python_ready(spark)
    shared = spark.sparkContext.broadcast(_table(spark.read.parquet(f"{path}/table")))

    def decode(batches):
        for b in batches:
            for shard, start, payload in zip(b["shard"], b["shard_start"], b["payload"]):
                block = rans.Block(payload)
                ids = block.decode(shared.value).astype("<u4").tobytes()
                ends = np.cumsum(block.lengths.astype(np.int64))
                begins = ends - block.lengths
                yield pd.DataFrame({"shard": shard, "at": start + begins,
                                    "doc_id": block.doc_ids, "has_id": block.present, "n_tokens": block.lengths.astype(np.int64),
                                    "ids": [ids[4 * s:4 * e] for s, e in zip(begins.tolist(), ends.tolist())]})

    from pyspark.sql import Window
    # one row per shard, as many as the writer had tasks
    base = spark.read.parquet(f"{path}/shards").select(
        F.col("shard").alias("of"), (F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens")).alias("base"))
    rows = spark.read.parquet(f"{path}/blocks").select("shard", "shard_start", "payload").mapInPandas(
        decode, "shard int, at long, doc_id long, has_id boolean, n_tokens long, ids binary")
    return rows.join(F.broadcast(base), F.col("shard") == F.col("of")).select(
        joined_id(), (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def op6_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` to a coded dataset in the shared folder, and the digests read back from it."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{spark.sparkContext.applicationId}/tokens-{uuid.uuid4().hex}"
    write(documents(spark, sf_dir), path)
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


