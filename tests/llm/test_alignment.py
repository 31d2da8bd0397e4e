"""Alignment of two tokenizers against whole texts encoded by the libraries and plain loops."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from auditlake.llm import alignment
from conftest import SF001

SCHEMA = "doc_id long, text string"
WORDS = "the of and house Übergröße naïve çé 123 don't (x) e.g. ... --- 日本語 한글 ελ x y ​z <|endoftext|> <0x41> <s> ﬁ a\tb 😀".split(" ")


@pytest.fixture(scope="module")
def encoders():
    return alignment.pair(*(public_tokenizers.path(n) for n in (alignment.BYTE_LEVEL, alignment.PIECES)))


def whole(encoders, text):
    """(ids, ids) by the libraries, over the whole text."""
    a = encoders.a.encode(" " + text, add_special_tokens=False).ids
    return a, encoders.b.encode(text)


def plain(encoders, texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, sha)."""
    per_text = []
    for text in texts:
        links, groups, sizes = [], [], (0, 0)
        a, b = whole(encoders, text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if text and b"".join(encoders.bytes_a[i] for i in a) == raw == b"".join(encoders.bytes_b[i] for i in b):
            sizes = len(a), len(b)
            ends_a = list(itertools.accumulate(len(encoders.bytes_a[i]) for i in a))
            ends_b = list(itertools.accumulate(len(encoders.bytes_b[i]) for i in b))
            i = j = 0
            while i < len(a):
                k, m = i + 1, j + 1
                while ends_a[k - 1] != ends_b[m - 1]:
                    if ends_a[k - 1] < ends_b[m - 1]:
                        k += 1
                    else:
                        m += 1
                groups.append(f"{','.join(map(str, a[i:k]))}|{','.join(map(str, b[j:m]))}")
                for x in range(i, k):
                    for y in range(j, m):
                        low = max(ends_a[x] - len(encoders.bytes_a[a[x]]), ends_b[y] - len(encoders.bytes_b[b[y]]))
                        if low < min(ends_a[x], ends_b[y]):
                            links.append((a[x], b[y]))
                i, j = k, m
        per_text.append((sizes, groups, links))
    count = Counter(p for _, _, links in per_text for p in set(links))
    highest = {}
    for (a, _), n in count.items():
        highest[a] = max(n, highest.get(a, 0))
    return [(*sizes, len(groups), len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for sizes, groups, links in per_text]


def texts():
    rng = random.Random(8)
    joins = [" "] * 12 + ["\n", "\n\n", "  ", "   ", "\r\n", "", " \n", "\n ", "\t", "\x0b", " ", "\x1c"]
    out = ["".join(rng.choice(WORDS) + rng.choice(joins) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    out += [None, "", " ", "  ", "\n", " a", "a ", "▁", "a ▁b", "x" * 5000, "日本" * 700, "\x00", "a" + " " * 300 + "b", out[3], out[3], "é", "\r", "the " * 3000]
    return out


def test_cutting_texts_changes_no_token(encoders):
    for text, got in zip(texts(), encoders.encode(texts())):
        if got is not None:
            assert [x.tolist() for x in got] == list(whole(encoders, text)), text
    assert encoders.encode(["", "a ▁b"]) == [None, None] and encoders.encode([]) == []


def test_fragments_compose_in_any_order(encoders):
    rng = random.Random(2)
    for text in filter(None, texts()[:60]):
        both = encoders.encode([text])[0]
        if both is None:
            continue
        t = alignment.Tokens(both[0], np.cumsum(encoders.size_a[both[0]]), both[1], np.cumsum(encoders.size_b[both[1]]))
        edges = sorted(rng.choices(range(int(t.end_a[-1])), k=6))
        made = [alignment.fragment(t.part(a, b)) for a, b in itertools.pairwise([0, *edges, int(t.end_a[-1])])]
        groups, parts = [g for _, g in made], [f for f, _ in made]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at:at + 2], closed = [(both := parts[at] + parts[at + 1])[0]], both[1]
            groups += [closed] if closed is not None else []
        groups.append(parts[0].prefix)
        assert not len(parts[0].suffix.a) and not len(parts[0].suffix.b)
        text_of = "".join(alignment.described(g)[1] for g in sorted((g for g in groups if len(g.a)), key=lambda g: g.end_a[0]))
        assert text_of == alignment.described(t)[1]


@pytest.mark.parametrize("chunk, fan_in", [(alignment.CHUNK, 16), (37, 2), (400, 3), (1, 16)])
def test_against_plain_loops(spark, encoders, monkeypatch, chunk, fan_in):
    monkeypatch.setattr(alignment, "FAN_IN", fan_in)
    own = texts()
    if chunk == 1:
        own = [t for t in own if len(t or "") < 200]
    rows = [(None if i % 11 == 5 else i // 2, t) for i, t in enumerate(own)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "pack", "whole", "chunk", "place", "n_a", "a", "b", "held", "counts", "number", "cut"):
        df = df.withColumn(c, F.lit("theirs"))
    got = alignment.align(df.repartition(3), chunk=chunk).select("doc_id", *alignment.RESULT, "groups_sha256").collect()
    want = [(doc, *r) for (doc, _), r in zip(rows, plain(encoders, [t for _, t in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(spark):
    df = alignment.align(spark.createDataFrame([], SCHEMA))
    assert df.columns == ["doc_id", *alignment.RESULT, "groups_sha256"] and df.count() == 0


def test_query_on_its_whole_table(spark, encoders):
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()
    want = [(d["doc_id"], *r) for d, r in zip(docs, plain(encoders, [d["text"] for d in docs]))]
    got = alignment.op13_tokenizer_alignment(spark, SF001).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert all(re.fullmatch("[0-9a-f]{64}|", r["groups_sha256"]) for r in got)
