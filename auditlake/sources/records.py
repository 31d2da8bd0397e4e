"""Records of CSV files, found and read in parallel, with line breaks inside quotes.

Files are cut into byte ranges.  For both states in which a range may begin
(outside or inside a quoted field) a task notes the state at its end, its
first record end and its record counts (``scan_ranges``).  These functions of
one bit compose, so a window over the ranges of a file, a few numbers each,
tells the true state of every range (``with_states``); no task reads a file
from its start.  What follows are slices of whole records with the number of
the record each begins with (``slices``), which any task can parse on its own
(``parse``).

A quote opens a field only at the field's start, and is doubled inside it.
In a file that ends inside a quoted field, the quote that opened it is taken
as text, and its records count as if it had not been there.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a range.
RANGE = 8 << 20
#: Bytes for each task that reads ranges or slices.
TASK_BYTES = 64 << 20
QUOTE, LF, CR = 34, 10, 13
#: Bytes that leave a record blank; quotes too, so that a record of one empty field is blank in either form.
BLANK = np.zeros(256, bool)
BLANK[[QUOTE, LF, CR, 9, 11, 12, 32]] = True
BOM = b"\xef\xbb\xbf"


def open_file(path: str):
    """A seekable byte stream of a local, mounted or remote file."""
    if path.startswith("file:") or "://" not in path:
        return open(path[5:] if path.startswith("file:") else path, "rb")
    from pyarrow.fs import FileSystem
    fs, at = FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return fs.open_input_file(at)


def tasks_for(n_bytes: int | None, spark) -> int:
    """Tasks that share so many bytes; no fewer than there are cores."""
    return max(spark.sparkContext.defaultParallelism, -(-int(n_bytes or 0) // TASK_BYTES))


# ---------------------------------------------------------------------------
# ranges
# ---------------------------------------------------------------------------

_STATE = "struct<out: int, first_end: long, head: boolean, inner: long, tail: boolean, opened: long, spilled: long>"
_STATE_TYPE = pa.struct([("out", pa.int32()), ("first_end", pa.int64()), ("head", pa.bool_()), ("inner", pa.int64()), ("tail", pa.bool_()),
                         ("opened", pa.int64()), ("spilled", pa.int64())])


def scan(data: bytes, lead: int, size: int, offset: int, delimiter: str, void: int | None) -> list[dict]:
    """What a range does from either state; ``data[lead:lead + size]`` is the range, at ``offset`` of its file.

    ``lead`` bytes before it and those behind it, up to one that is no quote,
    belong to ``data``.  out: state at its end; first_end: offset of its first
    record end, -1 without one; head, tail: whether text stands before its
    first and behind its last record end; inner: records between its record
    ends, blank ones left out; opened: offset of the quote that is open at its
    end, -1 if that lies before it; spilled: quoted fields that hold a line
    break and go on behind their closing quote, as after a stray quote.
    """
    at = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(at == QUOTE)
    first = np.flatnonzero(np.diff(quotes, prepend=-2) > 1)
    runs, length = quotes[first], np.diff(first, append=len(quotes))
    inside = (runs >= lead) & (runs < lead + size)
    runs, length = runs[inside], length[inside]
    before = at[np.maximum(runs - 1, 0)]
    starts = np.isin(before, [ord(delimiter), LF, CR]) | (offset - lead + runs == 0)
    if offset == 0 and data.startswith(BOM):
        starts |= runs == len(BOM)
    after = np.append(at, np.uint8(LF))[runs + length]
    ends_field = np.isin(after, [ord(delimiter), LF, CR])
    odd = length % 2 == 1
    if void is not None:
        odd &= offset - lead + runs != void
    toggles, resets = odd & starts, odd & ~starts
    toggled = np.cumsum(toggles)
    number = np.arange(len(runs))
    reset = np.maximum.accumulate(np.where(resets, number, -1)) if len(runs) else number
    lines = np.flatnonzero((at == LF) | ((at == CR) & (np.append(at[1:], 0) != LF)))
    lines = lines[(lines >= lead) & (lines < lead + size)]
    run_before = np.searchsorted(runs, lines) - 1
    is_text = ~BLANK[at[lead:lead + size]]
    if offset == 0 and data.startswith(BOM):
        is_text[:len(BOM)] = False
    text = np.concatenate([[0], np.cumsum(is_text, dtype=np.int32)])

    out = []
    for state in (0, 1):
        state_after = np.where(reset >= 0, toggled - toggled[reset], state + toggled) % 2 if len(runs) else number
        state_before = np.concatenate([[state], state_after[:-1]]) if len(runs) else number
        last = int(state_after[-1]) if len(runs) else state
        at_line = np.where(run_before >= 0, state_after[run_before], state) if len(runs) else np.full(len(lines), state)
        ends = lines[at_line == 0]
        opens = np.flatnonzero((state_before == 0) & (state_after == 1))
        broken = np.flatnonzero((state_before == 1) & odd & ~ends_field)
        opener = np.searchsorted(opens, broken) - 1
        since = np.where(opener >= 0, runs[opens[opener]] if len(opens) else 0, lead)
        spilled = int((np.searchsorted(lines, runs[broken]) > np.searchsorted(lines, since)).sum())
        words = text[ends - lead]
        out.append({"out": last, "first_end": offset - lead + int(ends[0]) if len(ends) else -1, "head": bool(len(ends) and words[0] > 0),
                    "inner": int((np.diff(words) > 0).sum()), "tail": bool(text[-1] > (words[-1] if len(ends) else 0)),
                    "opened": offset - lead + int(runs[opens[-1]]) if last and len(opens) else -1, "spilled": spilled})
    return out


def _read_range(fh, start: int, size: int) -> tuple[bytes, int]:
    """(bytes, how many of them stand before ``start``): one before the range, and those behind it up to one that is no quote."""
    lead = min(start, 1)
    fh.seek(start - lead)
    data = bytes(fh.read(lead + size))
    while len(data) >= lead + size:
        more = bytes(fh.read(1 << 12))
        kept = len(more) - len(more.lstrip(b'"'))
        data += more[:kept + 1]
        if kept < len(more) or not more:
            break
    return data, lead


def scan_ranges(ranges: DataFrame) -> DataFrame:
    """(file_id, start, by_state) of ranges (file_id, path, start, size, delimiter, void), by :func:`scan`."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                with open_file(r["path"]) as fh:
                    data, lead = _read_range(fh, r["start"], r["size"])
                found = scan(data, lead, min(r["size"], len(data) - lead), r["start"], r["delimiter"], r["void"])
                yield pa.RecordBatch.from_arrays([pa.array([r["file_id"]], pa.int64()), pa.array([r["start"]], pa.int64()),
                                                  pa.array([found], pa.list_(_STATE_TYPE))], ["file_id", "start", "by_state"])

    return ranges.select("file_id", "path", "start", "size", "delimiter", "void").mapInArrow(
        run, f"file_id long, start long, by_state array<{_STATE}>")


def with_states(scanned: DataFrame) -> DataFrame:
    """(file_id, start, end_state, and the fields of the true state) of every range.

    A range either ends in one state however it begins, or keeps or flips the
    state; so the state is the parity of the flips since the last range of
    the first kind.
    """
    by_file = Window.partitionBy("file_id").orderBy("start")
    fixed = F.col("by_state")[0]["out"] == F.col("by_state")[1]["out"]
    df = scanned.withColumn("_group", F.sum(fixed.cast("int")).over(by_file))
    since = Window.partitionBy("file_id", "_group").orderBy("start")
    df = df.withColumn("end_state", F.sum(F.col("by_state")[0]["out"]).over(since) % 2)
    df = df.withColumn("_state", F.coalesce(F.lag("end_state").over(by_file), F.lit(0)).cast("int"))
    return df.withColumn("_own", F.get("by_state", F.col("_state"))).select("file_id", "start", "end_state", "_own.*").drop("out")


def ranges_of(files: DataFrame, n_tasks: int) -> DataFrame:
    """(file_id, path, start, size, delimiter, void) of files (file_id, path, length, delimiter, void), dealt to the tasks."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE).cast("long"))).alias("start")
    cut = files.where("length > 0").select("file_id", "path", start, "length", "delimiter", "void")
    return cut.withColumn("size", F.least(F.lit(RANGE), F.col("length") - F.col("start"))).repartition(n_tasks, "file_id", "start")


def scanned_files(files: DataFrame, n_tasks: int, settle) -> DataFrame:
    """:func:`with_states` of files (file_id, path, length, delimiter), with ``void``: the offset of a quote that is text.

    ``settle`` writes a small table and reads it back.  Files that end inside
    a quoted field are scanned once more without the quote that opened it.
    """
    files = files.withColumn("void", F.lit(None).cast("long"))
    first = settle(with_states(scan_ranges(ranges_of(files, n_tasks))))
    open_end = first.groupBy("file_id").agg(F.max_by("end_state", "start").alias("last"), F.max("opened").alias("void")).where("last = 1")
    again_files = files.drop("void").join(open_end.select("file_id", "void"), "file_id")
    again = with_states(scan_ranges(ranges_of(again_files, n_tasks))).join(open_end.select("file_id", "void"), "file_id")
    sound = first.join(open_end, "file_id", "left_anti").withColumn("void", F.lit(None).cast("long"))
    return settle(sound.unionByName(again))


def slices(states: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, start, end, number, void): slices of whole records; ``number`` records of the file stand before.

    Blank records do not count.  ``files`` has (file_id, length).
    """
    by_file = Window.partitionBy("file_id").orderBy("start")
    df = states.withColumn("_breaks", (F.col("first_end") >= 0).cast("int"))
    df = df.withColumn("_part", F.sum("_breaks").over(by_file))
    open_text = F.max("tail").over(Window.partitionBy("file_id", "_part").orderBy("start"))
    df = df.withColumn("_open", open_text).withColumn("_carried", F.coalesce(F.lag("_open").over(by_file), F.lit(False)))
    df = df.where("_breaks = 1").withColumn("_first", (F.col("head") | F.col("_carried")).cast("long"))
    before = F.coalesce(F.sum(F.col("_first") + F.col("inner")).over(by_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edges = df.select("file_id", (F.col("first_end") + 1).alias("start"), (before + F.col("_first")).alias("number"))
    begins = files.select("file_id", F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("number"))
    edges = edges.unionByName(begins).join(files.select("file_id", "length"), "file_id")
    end = F.coalesce(F.lead("start").over(by_file), F.col("length"))
    voids = states.groupBy("file_id").agg(F.max("void").alias("void"))
    return edges.withColumn("end", end).where("start < end").join(voids, "file_id").select("file_id", "start", "end", "number", "void")


# ---------------------------------------------------------------------------
# records
# ---------------------------------------------------------------------------

def _as_text(data: bytes, at: int, delimiter: bytes) -> bytes:
    """``data`` with the field that begins with the quote at ``at`` written as quoted text."""
    ends = [e for e in (data.find(c, at) for c in (delimiter, b"\n", b"\r")) if e >= 0]
    end = min(ends, default=len(data))
    return data[:at] + b'"' + data[at:end].replace(b'"', b'""') + b'"' + data[end:]


def records(data: bytes, start: int, delimiter: str, encoding: str, void: int | None) -> Iterator[list[str]]:
    """Cells of each record of a slice that begins at ``start`` of its file; blank records are left out."""
    csv.field_size_limit(sys.maxsize)
    if void is not None and start <= void < start + len(data):
        data = _as_text(data, void - start, delimiter.encode())
    if start == 0:
        data = data.removeprefix(BOM)
    text = data.decode("utf-8" if encoding == "UTF-8" else "latin-1", "replace")
    for row in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter, quotechar='"', doublequote=True):
        if len(row) > 1 or row and row[0].strip(' \t\r\n\v\f"'):
            yield row


def read_slice(r: dict) -> Iterator[tuple[int, list[str]]]:
    """(rownum, cells) of the data records of a slice; the header is record 1 + skiprows."""
    with open_file(r["path"]) as fh:
        fh.seek(r["start"])
        data = bytes(fh.read(r["end"] - r["start"]))
    for rownum, row in enumerate(records(data, r["start"], r["delimiter"], r["encoding"], r["void"]), r["number"] - r["skiprows"]):
        if rownum >= 1:
            yield rownum, row


SLICE_COLUMNS = ["file_id", "path", "start", "end", "number", "void", "delimiter", "encoding", "skiprows", "columns"]


def parse(cut: DataFrame, fields: list[str]) -> DataFrame:
    """(file_id, rownum, time_text, raw_json, fields...) of slices (SLICE_COLUMNS, fields: map to positions, time_pos).

    ``raw_json`` holds the whole source row under its header names; cells that
    a row lacks are empty, those beyond the header are left out.
    """
    quoted = json.encoder.encode_basestring
    schema = ", ".join(["file_id long", "rownum long", "time_text string", "raw_json string", *[f"`{f}` string" for f in fields]])
    names = ["file_id", "rownum", "time_text", "raw_json", *fields]

    def batch(r: dict, keys: list[str], rows: list[tuple[int, list[str]]]) -> pa.RecordBatch:
        width = len(keys)
        cells = [row[:width] + [""] * (width - len(row)) for _, row in rows]
        place = dict(r["fields"] or {})
        whole = ["{" + ", ".join([k + quoted(v) for k, v in zip(keys, row)]) + "}" for row in cells]
        columns = [pa.array([r["file_id"]] * len(rows), pa.int64()), pa.array([n for n, _ in rows], pa.int64()),
                   pa.array([row[r["time_pos"]] for row in cells], pa.string()), pa.array(whole, pa.string())]
        for f in fields:
            at = place.get(f)
            columns.append(pa.array([""] * len(rows) if at is None else [row[at] for row in cells], pa.string()))
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for r in b.to_pylist():
                keys = [f"{quoted(c)}: " for c in unique_names(r["columns"])]
                held = []
                for row in read_slice(r):
                    held.append(row)
                    if len(held) >= 5000:
                        yield batch(r, keys, held)
                        held = []
                if held:
                    yield batch(r, keys, held)

    return cut.select(*SLICE_COLUMNS, "fields", "time_pos").mapInArrow(run, schema)


def parse_columns(cut: DataFrame, rows_at_once: int = 1000) -> DataFrame:
    """(file_id, rows, cells): up to ``rows_at_once`` rows of a slice by columns, cells[column][row]; for statistics of columns."""
    def run(batches: Iterator[pa.RecordBatch]):
        def batch(r: dict, held: list) -> pa.RecordBatch:
            width = len(r["columns"])
            cells = [row[:width] + [""] * (width - len(row)) for _, row in held]
            return pa.RecordBatch.from_arrays([pa.array([r["file_id"]], pa.int64()), pa.array([len(held)], pa.int64()),
                                               pa.array([list(map(list, zip(*cells)))], pa.list_(pa.list_(pa.string())))], ["file_id", "rows", "cells"])

        for b in batches:
            for r in b.to_pylist():
                held = []
                for row in read_slice(r):
                    held.append(row)
                    if len(held) >= rows_at_once:
                        yield batch(r, held)
                        held = []
                if held:
                    yield batch(r, held)

    return cut.select(*SLICE_COLUMNS).mapInArrow(run, "file_id long, rows long, cells array<array<string>>")


def unique_names(columns: list[str]) -> list[str]:
    """Header names made unique the way common CSV readers do: blank -> ``Unnamed: i``,
    repeats -> ``name.1``, ``name.2`` ..."""
    out, seen = [], {}
    for i, c in enumerate(columns):
        c = c if c != "" else f"Unnamed: {i}"
        if c in seen:
            seen[c] += 1
            c2 = f"{c}.{seen[c]}"
            while c2 in seen:
                seen[c] += 1
                c2 = f"{c}.{seen[c]}"
            seen[c2] = 0
            out.append(c2)
        else:
            seen[c] = 0
            out.append(c)
    return out
