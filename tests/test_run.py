"""End-to-end run over the sample logs plus sink round trips."""
import glob
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from auditlake.plans.run import run_triage
from conftest import SAMPLE_LOGS


@pytest.mark.skipif(not os.path.isdir(SAMPLE_LOGS), reason="sample logs not present")
def test_run_triage_sample(spark):
    out = tempfile.mkdtemp(prefix="auditlake-run-")
    rules = [{"name": "fwd", "family": "ual", "severity": "high", "match": {"contains_any": ["forwardto"]}}]
    res = run_triage(spark, SAMPLE_LOGS, out, mode="deep", rules=rules)
    f = res["findings"]
    # shipped sample subset: 16 audit findings (13 high / 3 medium)
    by = {(r["category"], r["severity"]): r["count"] for r in f.groupBy("category", "severity").count().collect()}
    assert by[("ual_suspicious_operation", "high")] == 13
    assert by[("ual_suspicious_operation", "medium")] == 3
    # sinks round trip
    back = spark.read.option("header", True).option("escape", '"').csv(f"{out}/findings.csv")
    assert back.count() == f.count()
    js = spark.read.json(f"{out}/findings.jsonl")
    assert js.count() == f.count() and "evidence" in js.columns
    fr = spark.read.option("header", True).option("escape", '"').csv(f"{out}/file_ranges.csv")
    assert fr.count() == 3 and fr.filter(F.col("start") == "").count() == 0
    tl = spark.read.option("header", True).option("escape", '"').csv(f"{out}/timeline.csv")
    assert tl.count() == 80
    kp = spark.read.json(f"{out}/report/kpis").first()
    assert kp["total_files"] == 3 and kp["signin_rows"] == 40 and kp["ual_rows"] == 40
    assert os.path.isdir(f"{out}/cases/events")
    prof = spark.read.json(f"{out}/schema_profiles.json")
    ual_prof = {r["name"]: r for r in prof.filter(F.col("file_id") == 1).collect()}
    assert ual_prof["Operation"]["n_sample"] == 40 and ual_prof["Operation"]["examples"] == [
        "Send", "FileAccessed", "Set-Mailbox"]
    assert sorted(r["pos"] for r in ual_prof.values()) == list(range(13))
    heat = spark.read.json(f"{out}/report/signin_heatmap_dow_hour")
    assert heat.count() == 168
