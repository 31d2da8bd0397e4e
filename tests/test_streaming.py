"""Streaming twins equal their batch operators on bounded input (availableNow)."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.operators import campaigns, sequence
from auditlake.schema import SIGNIN_SCHEMA
from auditlake.sources import adapters
from auditlake.streaming import streams
from conftest import SF001


def _signin_dir(spark):
    s, u, f = adapters.load_tables(spark, SF001)
    return s, u


def test_stream_campaign_equals_batch(spark):
    s, _ = _signin_dir(spark)
    d = tempfile.mkdtemp(prefix="auditlake-st-")
    s.write.mode("overwrite").parquet(f"{d}/in")
    st = spark.readStream.schema(s.schema).parquet(f"{d}/in")
    q = (streams.stream_campaign(st, "user", 1440, 4, 3, watermark="1 day")
         .writeStream.outputMode("update").format("memory").queryName("camp_u").trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT * FROM camp_u")
    from pyspark.sql import Window
    last = got.withColumn("_r", F.row_number().over(Window.partitionBy("user", "bucket").orderBy(F.desc("fails"))))
    got_rows = sorted(tuple(r) for r in last.filter("_r = 1").drop("_r").collect())
    exp = campaigns.campaign_brute(s, 1440, 4, 3, top=None).select("user", "bucket", "fails", "n_other",
                                                                   "min_ts", "max_ts")
    assert got_rows == sorted(tuple(r) for r in exp.collect())
    assert len(got_rows) > 5


def test_stream_saf_equals_batch(spark):
    rows = []
    # two users; bursts of failures then successes, out-of-order arrival inside the input
    for u, base in (("a@x", 1000), ("b@x", 50000)):
        for i in range(6):
            rows.append((u, base + i * 60, "50126"))
        rows.append((u, base + 400, "0"))
        rows.append((u, base + 460, "0"))
        for i in range(3):
            rows.append((u, base + 5000 + i, "50126"))
        rows.append((u, base + 5010, "0"))
    from conftest import events
    df = events(spark, [(u, ts, rt, "") for u, ts, rt in rows])
    d = tempfile.mkdtemp(prefix="auditlake-saf-")
    df.write.mode("overwrite").parquet(f"{d}/in")
    st = spark.readStream.schema(df.schema).parquet(f"{d}/in")
    q = (streams.stream_success_after_failures(st, 30, 3, watermark="0 seconds").writeStream.outputMode("append").format("memory")
         .queryName("saf_s").trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((r["user"], r["rownum"], r["fail_count"]) for r in spark.sql("SELECT * FROM saf_s").collect())
    exp = sorted((r["user"], int(r["rownum"]), int(r["details"].split(" ")[0]))
                 for r in sequence.det_success_after_failures(df, None, 30, 3).collect())
    assert got == exp and len(exp) == 4


def test_stream_row_findings_equal_batch(spark):
    s, u = _signin_dir(spark)
    d = tempfile.mkdtemp(prefix="auditlake-rowf-")
    s.write.parquet(f"{d}/s")
    u.write.parquet(f"{d}/u")
    got = streams.stream_row_findings(spark.readStream.schema(s.schema).parquet(f"{d}/s"), spark.readStream.schema(u.schema).parquet(f"{d}/u"))
    got.writeStream.format("memory").queryName("rowf").trigger(availableNow=True).start().awaitTermination()
    want = streams.stream_row_findings(s, u)
    rows = spark.table("rowf")
    assert rows.count() == want.count() > 0 and rows.exceptAll(want).isEmpty()


def test_stream_campaign_update_log(spark):
    s, _ = _signin_dir(spark)
    d = tempfile.mkdtemp(prefix="auditlake-camp-")
    s.write.mode("overwrite").parquet(f"{d}/in")
    st = spark.readStream.schema(s.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = streams.write_campaign_updates(streams.stream_campaign(st, "user", 1440, 4, 3, watermark="1 day"),
                                       f"{d}/log", f"{d}/ckpt")
    q.awaitTermination()
    got = sorted(tuple(r) for r in streams.latest_campaigns(spark, f"{d}/log", "user")
                 .select("user", "bucket", "fails", "n_other", "min_ts", "max_ts").collect())
    exp = campaigns.campaign_brute(s, 1440, 4, 3, top=None).select("user", "bucket", "fails", "n_other",
                                                                   "min_ts", "max_ts")
    assert got == sorted(tuple(r) for r in exp.collect()) and len(got) > 5


def _parts(spark, batches):
    """A folder with one Parquet file per batch of sign-in rows, in their order."""
    from conftest import events
    d = tempfile.mkdtemp(prefix="auditlake-parts-")
    os.makedirs(f"{d}/in")
    for i, rows in enumerate(batches):
        df = events(spark, rows)
        df.withColumn("rownum", F.col("rownum") + 100 * i).coalesce(1).write.parquet(f"{d}/part{i}")
        name = next(n for n in os.listdir(f"{d}/part{i}") if n.endswith(".parquet"))
        os.rename(f"{d}/part{i}/{name}", f"{d}/in/{i}.parquet")
        os.utime(f"{d}/in/{i}.parquet", (1000 + i, 1000 + i))
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in"), d


def _state_rows(query):
    return [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]


def test_stream_saf_state_goes_to_zero(spark):
    fail, good = "50126", "0"
    batches = [[("a@x", 100, fail, ""), ("b@x", 160, fail, "")], [("a@x", 4000, fail, ""), ("a@x", 4100, fail, ""), ("a@x", 4200, good, ""),
                                                                  ("a@x", 4300, good, "")], [("c@x", 90000, good, "")], [("c@x", 200000, good, "")]]
    st, _ = _parts(spark, batches)
    q = (streams.stream_success_after_failures(st, 30, 2, watermark="10 minutes").writeStream.outputMode("append").format("memory")
         .queryName("saf_zero").trigger(availableNow=True).start())
    q.awaitTermination()
    out = spark.sql("SELECT user, ts_epoch, fail_count FROM saf_zero").collect()
    assert [tuple(r) for r in out] == [("a@x", 4200, 2)]
    rows = _state_rows(q)
    assert max(rows) < 30 and rows[-1] <= 4  # the last success waits, with its timer


def test_stream_saf_waits_in_few_entries(spark):
    """A user with events in many minutes over several batches keeps a timer and entries by the hour, and the batch twin's results."""
    from auditlake.streaming import stateful
    rows = [("a@x", 1_000_000 + 61 * i, "0" if i % 9 == 8 else "50126", "") for i in range(600)]
    st, d = _parts(spark, [rows[i::3] for i in range(3)] + [[("z@x", 2_000_000, "0", "")]])
    q = (streams.stream_success_after_failures(st, 30, 3, watermark="1 day").writeStream.outputMode("append").format("memory")
         .queryName("saf_few").trigger(availableNow=True).start())
    q.awaitTermination()
    whole = spark.read.parquet(f"{d}/in")
    want = sequence.det_success_after_failures(whole, None, 30, 3).select("user", F.col("rownum").cast("long"), "timestamp",
                                                                          F.split("details", " ")[0].cast("long"))
    got = spark.sql("SELECT user, rownum, ts_epoch, fail_count FROM saf_few").collect()
    assert sorted((r["ts_epoch"], r["fail_count"]) for r in got) == [(1_000_000 + 61 * i, 8) for i in range(8, 600, 9)]
    assert len(got) == want.count()
    hours = (61 * 600) // stateful.SLOT + 2
    assert max(_state_rows(q)) <= 3 * hours + 10


def test_stream_campaign_state_is_small_entries(spark):
    """A bucket of one address with many users over several batches: right counts, and state that ends with the bucket."""
    batches = [[(f"u{i}@x", 1000 + i, "50126", "", "9.9.9.9") for i in range(k, k + 40)] for k in (0, 20, 60)] + [[("z@x", 900000, "50126", "", "1.1.1.1")]] * 2
    st, _ = _parts(spark, batches)
    got = streams.stream_campaign(st, "ip", 15, 5, 5, watermark="1 minute")
    q = got.writeStream.outputMode("update").format("memory").queryName("camp_small").trigger(availableNow=True).start()
    q.awaitTermination()
    last = [tuple(r) for r in spark.sql("SELECT * FROM camp_small").collect()]
    assert last[-1] == ("9.9.9.9", 1, 120, 100, 1000, 1099) and [r[3] for r in last] == [40, 60, 100]
    rows = _state_rows(q)
    assert max(rows) >= 100 and rows[-1] < 10


def test_stream_saf_counts_late_rows(spark):
    from conftest import events
    d = tempfile.mkdtemp(prefix="auditlake-late-")
    for i, ts in enumerate((100000, 200000, 100)):
        df = events(spark, [("a@x", ts, "50126", "")])
        df.coalesce(1).write.parquet(f"{d}/part{i}")
        os.makedirs(f"{d}/in", exist_ok=True)
        name = next(n for n in os.listdir(f"{d}/part{i}") if n.endswith(".parquet"))
        os.rename(f"{d}/part{i}/{name}", f"{d}/in/{i}.parquet")
        os.utime(f"{d}/in/{i}.parquet", (1000 + i, 1000 + i))
    st = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/in")
    q = (streams.stream_success_after_failures(st, 30, 3, watermark="10 minutes").writeStream.outputMode("append")
         .format("memory").queryName("saf_late").trigger(availableNow=True).start())
    q.awaitTermination()
    assert streams.dropped_rows(q) == 1


def test_latest_campaigns_lets_errors_through(spark):
    d = tempfile.mkdtemp(prefix="auditlake-log-")
    assert streams.latest_campaigns(spark, d, "ip").count() == 0
    os.makedirs(f"{d}/batch_id=0")
    with open(f"{d}/batch_id=0/part-0.parquet", "wb") as f:
        f.write(b"not a table")
    with pytest.raises(Exception):
        streams.latest_campaigns(spark, d, "ip").count()
