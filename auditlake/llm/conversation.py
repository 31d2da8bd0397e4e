"""Conversation structure repair by integer-minimum dynamic programming.

A conversation is sound when its role initials read ``(s?(ua)+)?`` and no turn
is blank or repeated.  The edits that make it so form a layered graph over
four states (nothing yet, after system, after user, after assistant).  The
weight of a path is one integer: its high digits are the cost, its low digits
the letters of the edits by position, of fixed width and padded with zeros at
the end.  The least integer is thus the cheapest repair, and among equally
cheap ones that whose letters come first.

Long conversations are cut: rows are dealt by ranges of (conversation, turn),
each task turns its stretch into blocks of at most BLOCK rows, and a block is
a table of the least weights from each state to each other.  Paths of one
block that end in different states never have equal letters, and none is the
beginning of another, as each ends with the edit of the block's last row.  So
the letters behind the block never decide between them, and the blocks of a
conversation are joined by cost and own letters alone.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.llm.common import materialise, python_ready

#: Letters of the edits in ASCII order (delete, insert, keep, rerole); digits 1 to 4 of the weight, of three bits each.
LETTERS, DIGIT_BITS = "DIKR", 3
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Rows whose paths share one weight, and edits that a row can take: two inserts before it and its own.
BLOCK, EDITS_A_ROW = 256, 3
#: States, the role that may follow each, and the state after it.  A system turn may only be the first.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {NOTHING: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
ROLES = {"u": "user", "a": "assistant"}
#: Cost and letters of the inserts behind the last row, for each state that it leaves.
TAIL = {NOTHING: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}
#: Marks of a row, one byte: a digit for the class of its role, plus these.
CLASSES, IS_TRUNCATED, MUST_GO = "sua", 4, 8
WHITE = " \t\n\x0b\x0c\r"


@functools.lru_cache(maxsize=200_000)
def paths(marks: bytes) -> list[str | None]:
    """Least paths through the rows with these marks: at 4 * from + to, ``cost:letters`` or None."""
    width = EDITS_A_ROW * DIGIT_BITS * len(marks)
    low = (1 << width) - 1
    found: list[str | None] = [None] * 16

    def before(letter: str, cost: int, rest: int) -> int:
        digit = LETTERS.index(letter) + 1
        return (rest >> width) + cost << width | digit << (width - DIGIT_BITS) | (rest & low) >> DIGIT_BITS

    for end in range(4):
        least = {end: 0}
        for mark in reversed(marks):
            role, extra = (CLASSES + "?")[mark & 3], TRUNCATED * bool(mark & IS_TRUNCATED)
            now: dict[int, int] = {}
            for state in range(4):
                options = [before("D", DELETE, least[state])] if state in least else []
                if not mark & MUST_GO:
                    wanted, then = NEXT[state]
                    if then in least:
                        options.append(before("R", REROLE + extra, least[then]))
                        if role == wanted:
                            options.append(before("K", KEEP + extra, least[then]))
                    if state == NOTHING and role == "s" and SYSTEM in least:
                        options.append(before("K", KEEP + extra, least[SYSTEM]))
                if options:
                    now[state] = min(options)
            # inserts before the row: a third one would lead back to a state already reached at less cost
            for _ in range(2):
                after = {state: [before("I", INSERT, now[then])] if then in now else [] for state, (_, then) in NEXT.items()}
                now = {state: min(([now[state]] if state in now else []) + inserted)
                       for state, inserted in after.items() if state in now or inserted}
            least = now
        for state, weight in least.items():
            letters = f"{weight & low:0{width // DIGIT_BITS}o}".rstrip("0") if marks else ""
            found[4 * state + end] = f"{weight >> width}:" + "".join(LETTERS[int(d) - 1] for d in letters)
    return found


def joined(blocks: list[list[str | None]]) -> tuple[int, str]:
    """(cost, letters) of the least repair over a conversation's blocks, in order."""
    behind = {state: cost for state, (cost, _) in TAIL.items()}
    chosen = []
    for block in reversed(blocks):
        width = max(len(p) for p in block if p)
        best: dict[int, tuple[int, int, str]] = {}
        for at, path in enumerate(block):
            state, end = divmod(at, 4)
            if path is not None and end in behind:
                cost, letters = path.split(":")
                digits = int("0" + "".join(str(LETTERS.index(c) + 1) for c in letters).ljust(width, "0"), 8)
                weight = int(cost) + behind[end] << DIGIT_BITS * width | digits
                if state not in best or weight < best[state][0]:
                    best[state] = weight, end, letters
        behind = {state: weight >> DIGIT_BITS * width for state, (weight, _, _) in best.items()}
        chosen.append({state: (end, letters) for state, (_, end, letters) in best.items()})
    state, out = NOTHING, []
    for block in reversed(chosen):
        state, letters = block[state]
        out.append(letters)
    return behind[NOTHING], "".join(out) + TAIL[state][1]


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text, copy, gone) after the damage that a checksum of their place deals.

    Null texts and roles count as one space, as do null ids and turns in the
    checksum.  A dropped row stays with ``gone`` set, so that no conversation
    gets lost; a repeated one comes twice, with copy 0 and 1.
    """
    space = F.lit(" ")
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"),
                                F.coalesce(F.col("role").cast("string"), space).alias("role"),
                                F.coalesce(F.col("text").cast("string"), space).alias("text"))
    place = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = rows.withColumn("deal", F.crc32(place) % 20)
    text = F.when(F.col("deal") == 1, "").when(F.col("deal") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("deal") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.when(F.col("deal") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
                       (F.col("deal") == 0).alias("gone"))


#: Order of a conversation's rows; rows of one turn by role, then by the digest of the text, so that copies stand side by side.
ORDER = ["turn", "role", "digest", "copy"]


def _marked(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, copy, gone, initial, mark, fault) of each row; no texts."""
    body = F.rtrim("text", F.lit(WHITE))
    plain = rows.select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", "gone",
                        (body == "").alias("blank"), (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("open"))
    same = "partition by gone, conv_id, role, digest order by turn nulls first, copy"
    seen = plain.withColumn("again", F.expr(f"row_number() over ({same}) > 1"))
    fault = F.when(F.col("blank"), "b").when(F.col("again"), "d").when(F.col("open"), "t").otherwise("")
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    mark = role + F.when(fault.isin("b", "d"), MUST_GO).when(fault == "t", IS_TRUNCATED).otherwise(0)
    return seen.select("conv_id", "turn", "role", "digest", "copy", "gone", initial.alias("initial"), mark.alias("mark"), fault.alias("fault"))


def _runs(batches, columns: list[str], key):
    """(key, rows) of neighbouring rows with the same key, the rows one at a time, whatever the batches."""
    rows = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in columns)))
    return itertools.groupby(rows, key)


STRETCH = ("conv_id long, part long, block long, paths array<string>, n long, blank long, duplicate long, truncated long, illegal long, "
           "first string, last string, low long, high long, turns long, low_known boolean")
_COUNTED = ["blank", "duplicate", "truncated", "illegal", "turns"]


def _stretches(marked: DataFrame) -> DataFrame:
    """One row per block of rows that a task holds of a conversation, see the module's text."""
    def run(batches):
        part = TaskContext.get().partitionId()
        columns = ["conv_id", "turn", "gone", "initial", "mark", "fault"]
        out = []
        for conv, rows in _runs(batches, columns, lambda r: r[0]):
            present = (r for r in rows if not r[2])
            for number in itertools.count():
                block = list(itertools.islice(present, BLOCK))
                if number and not block:
                    break
                turns = [r[1] for r in block if r[1] is not None]
                pairs = [a[3] + b[3] for a, b in zip(block, block[1:])]
                faults = [r[5] for r in block]
                out.append((conv, part, number, paths(bytes(r[4] for r in block)), len(block), faults.count("b"), faults.count("d"),
                            faults.count("t"), sum(p not in ("su", "ua", "au") for p in pairs),
                            block[0][3] if block else None, block[-1][3] if block else None,
                            turns[0] if turns else None, turns[-1] if turns else None, len(set(turns)), bool(turns)))
                if len(out) >= 2000:
                    yield _batch(out, STRETCH)
                    out = []
        if out:
            yield _batch(out, STRETCH)

    placed = marked.repartitionByRange("conv_id", *ORDER).sortWithinPartitions("conv_id", *ORDER)
    return placed.mapInArrow(run, STRETCH)


_TYPES = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, t in zip(zip(*rows), types)], list(names))


REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _repairs(stretches: DataFrame) -> DataFrame:
    """REPAIR of each conversation from its blocks, in order."""
    def run(batches):
        columns = [f.split()[0] for f in STRETCH.split(", ")]
        out = []
        for conv, rows in _runs(batches, columns, lambda r: r[0]):
            total, blocks, last, low, high = dict.fromkeys(_COUNTED, 0), [], None, None, None
            for r in rows:
                row = dict(zip(columns, r))
                if not row["n"]:
                    continue
                blocks.append(row["paths"])
                for c in _COUNTED:
                    total[c] += row[c]
                if last is not None:
                    total["illegal"] += last + row["first"] not in ("su", "ua", "au")
                if row["low_known"]:
                    total["turns"] -= high is not None and row["low"] == high
                    low, high = row["low"] if low is None else low, row["high"]
                last = row["last"]
            cost, audit = joined(blocks) if blocks else (0, "")
            gaps = high - low + 1 - total["turns"] if low is not None else 0
            out.append((conv, min(gaps, 2 ** 63 - 1), total["blank"], total["duplicate"], total["truncated"], total["illegal"], cost, audit))
            if len(out) >= 2000:
                yield _batch(out, REPAIR)
                out = []
        if out:
            yield _batch(out, REPAIR)

    placed = stretches.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return placed.mapInArrow(run, REPAIR)


def edited(letters: str, rows):
    """(role, text) of the repaired turns: ``letters`` carried out on the rows (role, text), one row at a time."""
    state = NOTHING
    for letter in letters:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            continue
        if letter == "K" and state == NOTHING and role[:1] == "s":
            state = SYSTEM
        else:
            initial, state = NEXT[state]
            role = role if letter == "K" else ROLES[initial]
        yield role, text


def _hashed(repairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The repairs with ``repaired_sha256``; each conversation's texts pass once, in order, none is kept.

    A digest of SHA-256 depends on its text from the first byte to the last,
    so the hashing of one conversation stays in one task; deciding does not.
    """
    def run(batches):
        names = [f.split()[0] for f in REPAIR.split(", ")]
        columns = [*names, "head", "role", "text"]
        out = []
        for _, group in _runs(batches, columns, lambda r: r[0]):
            head = next(group)
            sha, first = hashlib.sha256(), True
            for role, text in edited(head[7], ((r[9], r[10]) for r in group)):
                sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False
            out.append((*head[:8], sha.hexdigest()))
            if len(out) >= 2000:
                yield _batch(out, f"{REPAIR}, repaired_sha256 string")
                out = []
        if out:
            yield _batch(out, f"{REPAIR}, repaired_sha256 string")

    heads = repairs.withColumn("head", F.lit(0))
    present = rows.where(~F.col("gone")).select("conv_id", "turn", "role", F.unhex(F.md5("text")).alias("digest"), "copy", "text", F.lit(1).alias("head"))
    both = heads.unionByName(present, allowMissingColumns=True)
    placed = both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *ORDER)
    return placed.mapInArrow(run, f"{REPAIR}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """REPAIR and ``repaired_sha256`` per conv_id of rows (conv_id, turn, role, text, copy, gone) as :func:`damaged` gives them.

    Rows stand by turn, null first; rows of one turn by role, then by the
    digest of the text.  Rows without a conv_id form one conversation.  A row
    is a duplicate of any earlier row with equal role and text.  A
    conversation without rows has zeros, an empty audit and the digest of the
    empty string; an empty table gives no rows.  More columns are ignored.
    """
    python_ready(rows.sparkSession)
    stretches = materialise(_stretches(_marked(rows)), "stretches")
    return _hashed(materialise(_repairs(stretches), "repairs"), rows)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns after repair, from 1 on; ``rows`` as for :func:`repair`."""
    python_ready(rows.sparkSession)
    repairs = materialise(_repairs(materialise(_stretches(_marked(rows)), "stretches")), "repairs")

    def run(batches):
        out = []
        for conv, group in _runs(batches, ["conv_id", "audit", "role", "text"], lambda r: r[0]):
            head = next(group)
            for at, (role, text) in enumerate(edited(head[1], ((r[2], r[3]) for r in group)), 1):
                out.append((conv, at, role, text))
                if len(out) >= 2000:
                    yield _batch(out, "conv_id long, position long, role string, text string")
                    out = []
        if out:
            yield _batch(out, "conv_id long, position long, role string, text string")

    heads = repairs.select("conv_id", "audit", F.lit(0).alias("head"))
    present = rows.where(~F.col("gone")).withColumn("digest", F.unhex(F.md5("text"))).withColumn("head", F.lit(1))
    both = heads.unionByName(present.select("conv_id", *ORDER, "text", "head"), allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "head", *ORDER).mapInArrow(
        run, "conv_id long, position long, role string, text string")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all damaged ``conversations``."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
