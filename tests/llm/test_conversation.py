"""Conversation repair against a plain search over (cost, letters), row by row."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from auditlake.llm import conversation
from conftest import SF001

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        deal = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if deal == 0:
            continue
        row = (turn, "user" if deal == 4 else role, "" if deal == 1 else re.sub("[.!?]", "", text) if deal == 2 else text)
        kept += [row] * (2 if deal == 3 else 1)
    for kept in out.values():
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))
    return out


def plain_repair(kept):
    """All columns but conv_id; the search compares (cost, letters) as tuples."""
    faults, seen = [], set()
    for _, role, text in kept:
        body = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.lru_cache(maxsize=None)
    def best(i, roles, inserts):
        """Least (cost, letters) from row i on; ``roles`` is what the grammar still needs to know of the roles so far."""
        found = []
        if i == len(kept) and roles in ("", "a"):
            found.append((0, ""))
        if inserts < 3:
            for new in "ua":
                if follows(roles, new):
                    cost, letters = best(i, new, inserts + 1)
                    found.append((3 + cost, "I" + letters))
        if i < len(kept):
            cost, letters = best(i + 1, roles, 0)
            found.append((4 + cost, "D" + letters))
            if faults[i] not in ("blank", "duplicate"):
                extra = 3 * (faults[i] == "truncated")
                for new in "ua":
                    if follows(roles, new):
                        cost, letters = best(i + 1, new, 0)
                        found.append((3 + extra + cost, "R" + letters))
                own = kept[i][1][:1]
                if own in ("s", "u", "a") and follows(roles, own):
                    cost, letters = best(i + 1, own, 0)
                    found.append((extra + cost, "K" + letters))
        return min(found, default=(10 ** 9, ""))

    def follows(last, new):
        return (last + new) in ("s", "u", "su", "ua", "au")

    cost, letters = best(0, "", 0)
    out, i, last = [], 0, ""
    for c in letters:
        role, text = ("", "") if c == "I" else kept[i][1:]
        i += c != "I"
        if c != "D":
            needed = "assistant" if last == "u" else "user"
            role = role if c == "K" else needed
            out.append(f"{role}:{text}")
            last = role[:1]
    turns = {t for t, _, _ in kept if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(kept, kept[1:])]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, letters, hashlib.sha256("\n".join(out).encode()).hexdigest())


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(df, rows):
    got = {r["conv_id"]: tuple(r[c] for c in NAMES) for r in df.collect()}
    assert got == {conv: plain_repair(kept) for conv, kept in plain_damage(rows).items()}


def awkward():
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "tool", "", None, "admin", "User"], ["Yes.", "No", "", " \n", None, "Why?\t ", "é!", "Yes."]
    rows = [(c, t, rng.choice(roles[:3] if c % 2 else roles), rng.choice(texts) if rng.random() < .7 else f"Text {c} {t}.")
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, None, "user", "Hi."), (None, 3, "assistant", "Ho."), (None, 3, "assistant", "Ho."), (70, None, "user", "a."), (70, None, None, None),
             (71, -5, "system", "s."), (71, 10 ** 15, "user", "q?"), (72, 1, "user", "word " * 50000 + "."), (72, 1, "assistant", "b")]
    # conversations of which the damage leaves nothing
    gone = [c for c in range(1000, 1200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    return rows + [(c, 0, "user", "Gone.") for c in gone]


def test_awkward_conversations(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("digest", "copy", "gone", "mark", "part", "head", "initial", "deal"):
        df = df.withColumn(c, F.lit("theirs"))
    check(conversation.repair(conversation.damaged(df.repartition(3))), rows)


def test_long_conversation_over_many_tasks_and_blocks(spark):
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "user", "assistant", "system"]), rng.choice(["A.", f"B {t}", f"C {t}.", ""])) for t in range(400)]
    rows += [(c, 0, "user", "x.") for c in range(2, 40)]
    check(conversation.repair(conversation.damaged(spark.createDataFrame(rows, SCHEMA).repartition(4))), rows)


@pytest.mark.parametrize("block", [1, 2, 7, 256])
def test_blocks_of_any_size_give_the_same_repair(block):
    rng = random.Random(block)
    for _ in range(300):
        n = rng.randint(1, 14)
        kept = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["a.", "b", "", f"{t}."])) for t in range(n)]
        _, _, _, _, _, cost, letters, _ = plain_repair(kept)
        seen, marks = set(), []
        for _, role, text in kept:
            mark = {"system": 0, "user": 1, "assistant": 2}.get(role, 3)
            marks.append(mark + (8 if not text or (role, text) in seen else 4 if text[-1] != "." else 0))
            seen.add((role, text))
        blocks = [conversation.paths(bytes(marks[i:i + block])) for i in range(0, n, block)]
        assert conversation.joined(blocks) == (cost, letters)


def test_empty_table(spark):
    df = conversation.repair(conversation.damaged(spark.createDataFrame([], SCHEMA)))
    assert df.columns == ["conv_id", *NAMES] and df.count() == 0


def test_repaired_turns_alternate(spark):
    df = conversation.damaged(spark.createDataFrame(awkward(), SCHEMA))
    turns = conversation.repaired_turns(df).groupBy("conv_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(position, role))), x -> substr(x.role, 1, 1)), '') as roles")).collect()
    assert turns and all(re.fullmatch("(s?(ua)+)?", r["roles"]) for r in turns)


def test_query_on_its_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF001}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(conversation.op12_conversation_repair(spark, SF001), rows)
