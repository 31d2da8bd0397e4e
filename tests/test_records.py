"""Records of CSV files read in slices, against the csv module over whole files."""
import csv
import hashlib
import io
import random
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from auditlake.session import cut_lineage
from auditlake.sources import adapters, increments, records
from auditlake.sources.logs import ingest_logs
from auditlake.streaming import streams
from conftest import SF001

UAL_HEADER = "CreationDate,UserId,ClientIP,Operation,Workload,AuditData\n"


def row(i, data="{}"):
    return f"2025-01-01T10:{i // 60 % 60:02d}:{i % 60:02d}Z,u{i}@x.com,1.1.1.1,Send,Exchange,{data}\n"


def plain(data: bytes, delimiter: str):
    text = data.removeprefix(records.BOM).decode("utf-8", "replace")
    return [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if len(r) > 1 or r and r[0].strip(' \t\r\n\v\f"')]


def ends_open(data: bytes, delimiter: str) -> bool:
    """Whether the file ends inside a quoted field: then a last cell takes in whatever is appended."""
    more = plain(data + b"\nX\n", delimiter)
    return not more or more[-1] != ["X"]


def read_all(spark, folder, files):
    """{name: records} through ranges, states and slices."""
    listed = spark.createDataFrame([(i, str(folder / n), len(d), c) for i, (n, d, c) in enumerate(files)],
                                   "file_id long, path string, length long, delimiter string")
    states = records.scanned_files(listed, 4, cut_lineage)
    cut = records.slices(states, listed).join(listed.select("file_id", "path", "delimiter"), "file_id").orderBy("file_id", "start").collect()
    out = {n: [] for n, _, _ in files}
    for r in cut:
        r = r.asDict() | {"encoding": "UTF-8", "skiprows": 0}
        name = files[r["file_id"]][0]
        for number, cells in records.read_slice(r):
            assert number == len(out[name]), (name, r)
            out[name].append(cells)
    return out, states


@pytest.mark.parametrize("size", [1, 3, 8, 1000])
def test_slices_equal_whole_files(spark, monkeypatch, size):
    monkeypatch.setattr(records, "RANGE", size)
    rng = random.Random(size)
    folder = Path(tempfile.mkdtemp(prefix="auditlake-rec-"))
    files = []
    for i in range(150):
        data = "".join(rng.choice(['"', '"', '""', ",", ",", "a", "é", "\n", "\r\n", " ", "b,\"c\"", ',"x\ny",', "\r"]) for _ in range(rng.randint(1, 40)))
        data = (records.BOM if i % 9 == 0 and size > 3 else b"") + data.encode()
        if not ends_open(data, ","):
            files.append((f"f{i}.csv", data, ","))
    for name, data, _ in files:
        (folder / name).write_bytes(data)
    # row numbers start at 1 for the record after the header, so records are read with the header as number 0
    monkeypatch.setattr(records, "read_slice", lambda r: ((n, c) for n, c in enumerate(records.records(
        Path(r["path"]).read_bytes()[r["start"]:r["end"]], r["start"], r["delimiter"], "UTF-8", r["void"]), r["number"])))
    got, _ = read_all(spark, folder, files)
    assert len(files) > 60
    for name, data, delimiter in files:
        assert got[name] == plain(data, delimiter), (name, data)


@pytest.mark.parametrize("where", ["early", "late", "header_next", "field_end"])
def test_unclosed_quote_loses_no_row(spark, where):
    folder = Path(tempfile.mkdtemp(prefix="auditlake-open-"))
    lines = [row(i) for i in range(2000)]
    at = {"early": 5, "late": 1990, "header_next": 0, "field_end": 700}[where]
    lines[at] = row(at, '"oops, {}') if where != "field_end" else row(at, '"')
    (folder / "ual_open.csv").write_text(UAL_HEADER + "".join(lines))
    (folder / "ual_fine.csv").write_text(UAL_HEADER + row(1, '"{""a"": ""x\ny""}"') + row(2, 'say "hi"') + row(3))
    r = ingest_logs(spark, str(folder))
    files = {x["name"]: x for x in r["files"].collect()}
    assert files["ual_open.csv"]["rows"] == 2000 and "never closed" in files["ual_open.csv"]["error"]
    assert files["ual_fine.csv"]["rows"] == 3 and files["ual_fine.csv"]["error"] == ""
    ual = r["ual"].join(r["files"].select("file_id", "name"), "file_id")
    got = {x["rownum"]: (x["user"], x["auditdata"]) for x in ual.where("name = 'ual_open.csv'").collect()}
    assert got[at + 1] == (f"u{at}@x.com", '"' if where == "field_end" else '"oops') and got[2000] == ("u1999@x.com", "{}" if at != 1999 else '"oops')
    fine = sorted((x["rownum"], x["auditdata"]) for x in ual.where("name = 'ual_fine.csv'").collect())
    assert fine == [(1, '{"a": "x\ny"}'), (2, 'say "hi"'), (3, "{}")]


def test_stray_quote_closed_later_is_reported(spark):
    folder = Path(tempfile.mkdtemp(prefix="auditlake-stray-"))
    (folder / "ual.csv").write_text(UAL_HEADER + row(1) + row(2, '"oops') + row(3) + row(4, '"{""a"": 1}"') + row(5))
    files = ingest_logs(spark, str(folder))["files"].collect()
    assert "go on behind" in files[0]["error"]


def test_large_file_with_line_breaks_is_read_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(records, "RANGE", 4096)
    monkeypatch.setattr(records, "TASK_BYTES", 8192)
    folder = Path(tempfile.mkdtemp(prefix="auditlake-large-"))
    (folder / "ual_big.csv").write_text(UAL_HEADER + "".join(row(i, f'"{{""t"": ""a{i}\r\nb,c""}}"') for i in range(3000)))
    r = ingest_logs(spark, str(folder))
    tasks = r["ual"].groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(tasks) > 10 and max(t["count"] for t in tasks) < 1000
    got = r["ual"].orderBy("rownum").select("rownum", "user", "auditdata", "ts_epoch").collect()
    assert [x["rownum"] for x in got] == list(range(1, 3001)) and got[2999]["user"] == "u2999@x.com"
    assert got[7]["auditdata"] == '{"t": "a7\r\nb,c"}' and all(x["ts_epoch"] for x in got)


def test_many_headers_make_one_plan(spark):
    folder = Path(tempfile.mkdtemp(prefix="auditlake-many-"))
    for i in range(1000):
        extra = f"Extra{i}"
        (folder / f"ual_{i:04d}.csv").write_text(f"{extra},CreationDate,UserId,Operation,AuditData\nx{i},2025-01-01T00:00:00Z,u{i}@x,Send,{{}}\n")
    r = ingest_logs(spark, str(folder))
    plan = r["ual"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("Union") == 0
    got = r["ual"].select("user", "raw_json").collect()
    assert len(got) == 1000 and {x["user"] for x in got} == {f"u{i}@x" for i in range(1000)}
    assert r["files"].where("rows = 1").count() == 1000


def _folder(n):
    folder = Path(tempfile.mkdtemp(prefix="auditlake-inc-"))
    for i in range(n):
        (folder / f"ual_{i}.csv").write_text(UAL_HEADER + row(i) + row(i + 1))
    return folder


def test_only_new_and_changed_files_are_read(spark):
    folder, tables = _folder(3), tempfile.mkdtemp(prefix="auditlake-tables-")
    assert increments.current_tables(spark, tables)["ual"].count() == 0
    assert increments.ingest_new(spark, str(folder), tables) == 1
    assert increments.ingest_new(spark, str(folder), tables) is None
    (folder / "ual_9.csv").write_text(UAL_HEADER + row(9))
    (folder / "ual_0.csv").write_text(UAL_HEADER + row(50) + row(51) + row(52))
    assert increments.ingest_new(spark, str(folder), tables) == 2
    assert sorted(r["name"] for r in increments.all_files(spark, tables).where("batch = 2").collect()) == ["ual_0.csv", "ual_9.csv"]
    now = increments.current_tables(spark, tables)
    files = {r["name"]: r for r in now["files"].collect()}
    assert {n: f["rows"] for n, f in files.items()} == {"ual_0.csv": 3, "ual_1.csv": 2, "ual_2.csv": 2, "ual_9.csv": 1}
    assert files["ual_0.csv"]["sha256"] == hashlib.sha256((folder / "ual_0.csv").read_bytes()).hexdigest()
    users = sorted(r["user"] for r in now["ual"].collect())
    assert users == sorted(f"u{i}@x.com" for i in (50, 51, 52, 1, 2, 2, 3, 9))
    assert now["ual"].select("file_id").distinct().count() == 4


def test_a_batch_tried_again_adds_no_row(spark):
    folder, tables = _folder(4), tempfile.mkdtemp(prefix="auditlake-tables-")
    listing = increments.listed(spark.read.format("binaryFile").load(str(folder)))
    first, second = listing.where("name < 'ual_2'"), listing.where("name >= 'ual_2'")
    assert [increments.append_batch(spark, x, tables, o) for x, o in ((first, "s#0"), (second, "s#1"), (first, "s#0"), (second, "s#1"))] == [1, 2, 1, 2]
    # a batch that failed before its files were written leaves rows that nothing reads
    spark.range(3).selectExpr("id AS file_id").write.parquet(f"{tables}/junk")
    increments.current_tables(spark, tables)["ual"].write.parquet(f"{tables}/ual/batch=3")
    now = increments.current_tables(spark, tables)
    assert now["ual"].count() == 8 and now["files"].count() == 4


def test_stream_ingest_equals_batch(spark):
    logs = adapters.write_log_folder(spark, SF001)
    out = tempfile.mkdtemp(prefix="auditlake-stream-")
    for _ in range(2):  # the second start finds nothing new
        streams.stream_ingest(spark, logs, f"{out}/tables", f"{out}/ckpt", max_files_per_trigger=3).awaitTermination()
    now, batch = increments.current_tables(spark, f"{out}/tables"), ingest_logs(spark, logs)
    assert increments.all_files(spark, f"{out}/tables").agg(F.max("batch")).first()[0] > 1
    for name in ("signin", "ual"):
        columns = [c for c in batch[name].columns if c != "file_id"]
        a, b = now[name].select(*columns), batch[name].select(*columns)
        assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_files_are_counted_in_the_tables_given(spark):
    """Counts come from the given tables, so that written ones need no second parse; a file without rows has none."""
    from auditlake.sources.logs import counted_files
    described = spark.createDataFrame(
        [(i, f"/l/{i}.csv", f"{i}.csv", "signin", "x", ",", 0, ["a"], "UTF-8", "") for i in (1, 2, 3)],
        "file_id long, path string, name string, family string, sha256 string, delimiter string, skiprows int, columns array<string>, "
        "encoding string, error string")
    signin = spark.createDataFrame([(1, 10), (1, 5), (1, None)], "file_id long, ts_epoch long")
    ual = spark.createDataFrame([(2, None)], "file_id long, ts_epoch long")
    files = counted_files(described, signin, ual)
    assert sorted((r["file_id"], r["rows"], r["start_epoch"], r["end_epoch"]) for r in files.collect()) == [
        (1, 3, 5, 10), (2, 1, None, None), (3, 0, None, None)]
