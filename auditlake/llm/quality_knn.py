"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes counts of hashed words, word shapes and layout marks; counts
are weighted by inverse document frequencies over all documents and projected
on the main directions of a labelled sample.  The sample's vectors, a bounded
number, go to every task; blocks of documents take exact cosine products with
all of them, and the nearest ones vote with their similarity.
"""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import documents, joined_id, materialise, python_ready, split_id

#: Bound of the labelled sample that is fitted on and votes, chosen by a hash of the id.
SAMPLE_ROWS = 4000
BUCKETS, DIRECTIONS, NEIGHBOURS, BLOCK = 1024, 64, 25, 1024
THRESHOLD = 0.3
_WORD = re.compile("[^\x20\x09-\x0D]+")


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as A, a, 9; other runs as their character."""
    out: list[str] = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _bucket(name: str, low: int) -> int:
    return low + zlib.crc32(name.encode("utf-8", "surrogatepass")) % BUCKETS


class Counter:
    """Counts of hashed words (buckets 0..BUCKETS-1) and of shapes and layout marks (the next BUCKETS)."""

    def __init__(self, remember: int = 500_000):
        self.known: dict[str, tuple[int, int]] = {}
        self.remember = remember

    def __call__(self, text: str) -> np.ndarray:
        words = _WORD.findall(text)
        ids = list(map(self.known.get, words))
        if None in ids:
            if len(self.known) > self.remember:
                self.known.clear()
            for w in {w for w, i in zip(words, ids) if i is None}:
                self.known[w] = (_bucket(w.lower(), 0), _bucket("w" + shape(w), BUCKETS))
            ids = [self.known[w] if i is None else i for w, i in zip(words, ids)]
        counts = np.bincount(np.array(ids, np.int64).ravel(), minlength=2 * BUCKETS).astype(np.int64)
        lines = [x for x in text.split("\n") if _WORD.search(x)]
        n, m, letters = len(words), len(lines), sum(map(len, words))
        tenth = lambda a, b: int(10 * a / b) if b else -1
        marks = (
            ("words", int(math.log2(n)) if n else -1), ("line", int(2 * math.log2(max(1, n / m))) if m else -1),
            ("same_lines", tenth(m - len(set(lines)), m)), ("own_words", tenth(len(set(words)), n) if n >= 20 else -1),
            ("letters", int(letters / n) if n else -1), ("capitals", tenth(sum(map(str.isupper, text)), letters)),
            ("marks", tenth(letters - sum(map(str.isalnum, text)), letters)))
        for name, value in marks:
            counts[_bucket(f"m{name}:{value}", BUCKETS)] += max(1, n // 8)
        return counts


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, has_id, at, n): the buckets of each whole text that are not empty, and their counts, as bytes."""
    python_ready(docs.sparkSession)

    def run(batches):
        count = Counter()
        for b in batches:
            at, n = [], []
            for t in b["text"]:
                c = count(t or "")
                hit = np.flatnonzero(c)
                at.append(hit.astype("<u2").tobytes())
                n.append(c[hit].astype("<u4").tobytes())
            yield pd.DataFrame({"doc_id": b["doc_id"], "has_id": b["has_id"], "at": at, "n": n})

    return split_id(docs, "text").mapInPandas(run, "doc_id long, has_id boolean, at binary, n binary")


def document_frequencies(counts: DataFrame) -> np.ndarray:
    """In how many documents each bucket occurs, over all of them; as many numbers as buckets."""
    def run(batches):
        total = np.zeros(2 * BUCKETS, np.int64)
        for b in batches:
            total += np.bincount(np.frombuffer(b"".join(b["at"]), "<u2"), minlength=2 * BUCKETS)
        yield pd.DataFrame({"bucket": np.arange(2 * BUCKETS), "docs": total})

    got = counts.select("at").mapInPandas(run, "bucket int, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    found = np.zeros(2 * BUCKETS)
    found[got["bucket"].to_numpy()] = got["docs"].to_numpy()
    return found


def weighted(at: list[bytes], n: list[bytes], idf: np.ndarray) -> np.ndarray:
    """Rows of TF-IDF weights; words and shapes each have length 1."""
    x = np.zeros((len(at), 2 * BUCKETS), np.float32)
    for row, a, c in zip(x, at, n):
        row[np.frombuffer(a, "<u2")] = 1 + np.log(np.frombuffer(c, "<u4"))
    x *= idf
    for half in (x[:, :BUCKETS], x[:, BUCKETS:]):
        half /= np.maximum(np.linalg.norm(half, axis=1, keepdims=True), 1e-12)
    x[:, :BUCKETS] *= 0.5
    return x


def directions(x: np.ndarray, k: int = DIRECTIONS, rounds: int = 6) -> np.ndarray:
    """The main right singular directions by subspace iteration."""
    k = min(k, *x.shape)
    basis, _ = np.linalg.qr(np.random.default_rng(5).standard_normal((x.shape[1], k)).astype(np.float32))
    for _ in range(rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    return basis


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def score(docs: DataFrame, labelled: DataFrame, sample_rows: int = SAMPLE_ROWS, neighbours: int = NEIGHBOURS) -> DataFrame:
    """(doc_id, score) of every row of ``docs``; ``labelled`` has (doc_id, label 0 or 1) to learn from.

    The score is the vote of the nearest labelled vectors, weighted by cosine,
    between 0 and 1; 0.5 where there is nothing to learn from.  Null and empty
    texts are scored by their layout marks like any other; repeated rows get
    the same score, and of a labelled id with several texts the one with the
    least counts votes; documents never vote by their id, source or language.
    """
    spark = docs.sparkSession
    counts = materialise(counted(docs), "counts")
    chosen = labelled.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    chosen = materialise(chosen.select(F.col("doc_id").alias("of"), F.col("label").cast("int").alias("label")), "chosen")
    sample = counts.where("has_id").join(F.broadcast(chosen), F.col("doc_id") == F.col("of")).groupBy("of", "label").agg(
        F.min(F.struct("at", "n")).alias("least")).select("of", "label", "least.at", "least.n").toPandas().sort_values("of")  # at most sample_rows rows
    idf = np.log((1 + counts.count()) / (1 + document_frequencies(counts))).astype(np.float32) + 1
    if len(sample):
        x = weighted(sample["at"], sample["n"], idf)
        basis = directions(x)
        model = (idf, basis, _unit(x @ basis), sample["label"].to_numpy(np.float32))
    else:
        model = (idf, None, None, None)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        idf, basis, known, label = shared.value
        for b in batches:
            out = np.full(len(b), 0.5)
            for at in range(0, len(b) if basis is not None else 0, BLOCK):
                part = slice(at, at + BLOCK)
                cos = _unit(weighted(b["at"][part], b["n"][part], idf) @ basis) @ known.T
                k = min(neighbours, cos.shape[1])
                near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
                weight = np.maximum(np.take_along_axis(cos, near, axis=1), 1e-6).astype(np.float64) ** 4
                out[part] = (weight * label[near]).sum(axis=1) / weight.sum(axis=1)
            yield pd.DataFrame({"doc_id": b["doc_id"], "has_id": b["has_id"], "score": out})

    return counts.mapInPandas(run, "doc_id long, has_id boolean, score double").select(joined_id(), "score")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``, learned from ``labels.quality`` of rows that are not held out."""
    kept_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~kept_out).select("doc_id", F.col("quality").alias("label"))
    return score(documents(spark, sf_dir), labels).select(
        "doc_id", kept_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"))
