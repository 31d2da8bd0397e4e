"""Rules validation, entry smoke check, and an oracle subset at sf0.001."""
import pytest

from auditlake.operators.rules import validate_rules
from conftest import SF001
from oracle_check import compare


def test_validate_rules_defaults():
    rs = validate_rules({"rules": [{"name": " r1 ", "family": "UAL", "match": {"regex": "x"}},
                                   {"family": "ual"}, "not a dict",
                                   {"name": "r2", "severity": "HIGH", "title": "T", "category": " c "}]})
    assert [(r.name, r.family, r.severity, r.category, r.title) for r in rs] == [
        ("r1", "ual", "medium", "custom_rule", "r1"), ("r2", "", "high", "c", "T")]


def test_entry_flagship(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert compare(spark, SF001, ["det_bruteforce_day"], verbose=False)["det_bruteforce_day"][0] == "ok"
    assert df.count() == E.queries()["det_bruteforce_day"](spark, SF001).count() > 0
    assert "finding_id" in df.columns


SUBSET = ["det_bruteforce_day", "det_password_spray", "det_risky_signin", "det_ual_suspicious",
          "det_impossible_travel", "det_success_after_failures", "join_asof_ual_signin", "det_rules_ual",
          "bec_external_domains", "agg_heatmap", "win_last_n_user_events", "union_findings_quick",
          "det_success_after_failures_default", "sort_findings", "sort_findings_report", "stream_password_spray", "stream_bruteforce",
          "stream_success_after_failures", "stream_row_detectors", "stream_ingest", "sink_normalized", "sink_file_ranges",
          "sink_report_tables", "fn_compress_text", "ingest_signin", "ingest_ual", "ingest_files", "ingest_row_provenance", "ingest_raw_json"]


@pytest.mark.parametrize("key", SUBSET)
def test_oracle_subset(spark, key):
    res = compare(spark, SF001, [key], verbose=False)
    assert res[key][0] == "ok", res[key]


def test_every_query_has_oracle():
    from auditlake import registry
    assert set(registry.oracle_sql()) == set(registry.queries())


def test_rules_from_dataframe(spark):
    from auditlake.operators.rules import rules_frame
    df = rules_frame(spark, [{"name": "r", "family": "ual", "severity": "LOW",
                              "match": {"contains_all": ["a", "b"], "regex": "x+"}}])
    rs = validate_rules(df)
    assert [(r.name, r.family, r.severity, r.contains_all, r.regex) for r in rs] == [
        ("r", "ual", "low", ["a", "b"], "x+")]


def test_many_rules_by_index_equal_compiled_rules(spark, monkeypatch):
    import random
    from pyspark.sql import functions as F
    from auditlake.operators import rules as R
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeXé") for _ in range(rng.randint(2, 5)))
    texts = [" ".join(word() for _ in range(rng.randint(0, 12))) for _ in range(80)] + ["", "\U0001f600abc", None]
    ual = spark.createDataFrame([(1 + i % 3, i // 2, "", "u", "", "op" if i % 5 else "Add", t) for i, t in enumerate(texts)],
                                "file_id int, rownum long, ts_iso string, user string, ip string, operation string, auditdata string")
    rules = [{"name": "all", "family": "ual"}, {"name": "grp", "family": "ual", "match": {"regex": "(ab|cd)e"}}]
    for i in range(60):
        match = {}
        if i % 3 == 0 or i % 7 == 0:
            match["contains_any"] = [word() for _ in range(rng.randint(1, 3))]
        if i % 3 == 1:
            match["contains_all"] = [word()[:3] for _ in range(rng.randint(1, 2))]
        if i % 3 == 2 or i % 11 == 0:
            match["regex"] = rng.choice(["a", "ab", "cde", "X"]) + rng.choice([".*", "?", "*", "+", ""]) + rng.choice(["ab", "dec", "Xa", "e$"])
        rules.append({"name": f"r{i}", "family": "ual", "severity": "high", "match": match})
    monkeypatch.setattr(R, "COMPILED_RULES", 1000)
    want = sorted(map(tuple, R.det_rules_ual(ual, rules).collect()))
    monkeypatch.setattr(R, "COMPILED_RULES", 5)
    compiled, looked_up = R.split_rules(R.validate_rules(rules))
    assert len(looked_up) > 15 and len(compiled) > 5
    got = R.det_rules_ual(ual, rules).collect()
    assert sorted(map(tuple, got)) == want
    assert {r["finding_id"].split("-")[1] for r in got} & {r.name for r in looked_up}
    assert R.det_rules_ual(ual.where(F.lit(False)), rules).count() == 0


def test_ten_thousand_rules_plan_in_seconds(spark):
    import time
    from auditlake.operators import rules as R
    from auditlake.sources import adapters
    _, ual, files = adapters.load_tables(spark, SF001)
    rules = [{"name": f"r{i}", "family": "ual", "match": {"contains_any": [f"needle{i}", f"mailbox{i}"]}} for i in range(10_000)]
    rules.append({"name": "hit", "family": "ual", "match": {"contains_any": [ual.where("length(operation) > 3").first()["operation"]]}})
    begin = time.time()
    found = R.det_rules_ual(ual, rules, files)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - begin < 20
    want = R.det_rules_ual(ual, rules[-1:], files)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_findings_are_built_behind_the_explode(spark):
    """Counting findings builds no evidence; each row has a finding for every detector and rule that it meets."""
    from pyspark.sql import functions as F

    from auditlake.operators import row_detectors
    from auditlake.schema import FINDING_COLUMNS, SIGNIN_SCHEMA
    rows = [{"file_id": 1, "rownum": i, "client_app": app, "risk_level": risk, "result_type": "0"}
            for i, (app, risk) in enumerate([("IMAP4", "high"), ("Browser", "low"), ("POP3", ""), (None, None)], 1)]
    signin = spark.createDataFrame([tuple(r.get(c, "") for c in SIGNIN_SCHEMA.names) for r in
                                    [{"ts_epoch": 0, **r} for r in rows]], SIGNIN_SCHEMA)
    rules = [{"name": "imap", "family": "signin", "match": {"regex": r"IMAP\d"}}, {"name": "all", "family": "signin", "match": {}}]
    found = row_detectors.fused_signin_findings(signin, None, rules)
    assert found.columns == [*FINDING_COLUMNS, "detector_no"]
    got = sorted((r["rownum"], r["detector_no"], r["finding_id"]) for r in found.collect())
    want = [("1", 1, "RISKY-SIGNIN-1-1"), ("1", 2, "LEGACY-AUTH-1-1"), ("1", 10, "RULE-all-1-1"), ("1", 10, "RULE-imap-1-1"),
            ("2", 10, "RULE-all-1-2"), ("3", 2, "LEGACY-AUTH-1-3"), ("3", 10, "RULE-all-1-3"), ("4", 10, "RULE-all-1-4")]
    assert got == want
    plan = found.groupBy("severity").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan.lower() and "StructsToJson" not in plan
