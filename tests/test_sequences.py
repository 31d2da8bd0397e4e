"""Sequence detectors and the as-of join against plain sequential loops (property tests)."""
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from auditlake.operators import correlate, sequence
from conftest import events


def _py_fail(rt, stt):
    t = rt.strip()
    if t.isdigit():
        return int(t) != 0
    return any(w in stt.lower() for w in ("fail", "error", "denied", "blocked"))


def _py_ok(rt, stt):
    t = rt.strip()
    if t.isdigit():
        return int(t) == 0
    return "success" in stt.lower()


def _sql_fail(rt, stt):
    if rt[:1].isdigit():
        digits = ""
        for ch in rt:
            if not ch.isdigit():
                break
            digits += ch
        return int(digits) != 0
    return any(w in stt.lower() for w in ("fail", "error", "denied", "blocked"))


def _sql_ok(rt, stt):
    if rt[:1].isdigit():
        return not _sql_fail(rt, stt)
    return "success" in stt.lower()


def saf_loop(rows, window, m):
    """Reference semantics: per user in time order, prune, append failures, emit + clear."""
    out = []
    by_user = {}
    for i, r in enumerate(rows):
        by_user.setdefault(r[0], []).append((r[1], i + 1, r))
    for user, evs in by_user.items():
        if user == "":
            continue
        nf = sum(1 for _, _, r in evs if _sql_fail(r[2], r[3]))
        ns = sum(1 for _, _, r in evs if _sql_ok(r[2], r[3]))
        if nf < m or ns < 1:
            continue
        fails = []
        for ts, rn, r in sorted(evs, key=lambda e: (e[0], e[1])):
            fails = [f for f in fails if ts - f <= window]
            if _py_fail(r[2], r[3]):
                fails.append(ts)
                continue
            if _py_ok(r[2], r[3]) and len(fails) >= m:
                out.append((user, rn, len(fails)))
                fails = []
    return sorted(out)


RT = st.sampled_from([("50126", ""), ("0", ""), ("", "Success"), ("", "failed"), ("", ""), ("50076 mfa", "")])


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", ""]), st.integers(0, 20000), RT), min_size=1, max_size=60),
       st.integers(1, 4), st.sampled_from([1800, 2500, 21600]),
       st.sampled_from([(1, 2, 2), (1, 2, 4), (2, 3, 1), (1024, 1024, 2)]))
def test_saf_matches_loop(spark, evs, m, chunk, size):
    rows = [(u, ts, rt, s, ("10.0.0.1", "10.0.0.2", "")[ts % 3], "ES", "app", "cli") for u, ts, (rt, s) in evs]
    df = events(spark, rows)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sequence, "FAN_IN", size[1])
        patch.setattr(sequence, "LEVELS", size[2])
        res = sequence.det_success_after_failures(df, None, 30, m, chunk_seconds=chunk, segment_blocks=size[0]).collect()
    got = sorted((r["user"], int(r["rownum"]), int(r["details"].split(" ")[0])) for r in res)
    assert got == saf_loop(rows, 1800, m)
    import json
    from collections import Counter
    for r in res:  # evidence holds exactly the counted failures
        e = json.loads(r["evidence_json"])
        assert len(e["fail_refs"]) == min(50, e["fail_count"]) and [x["ts"] for x in e["fail_refs"]] == sorted(x["ts"] for x in e["fail_refs"])
        counts = Counter(x["ip"] for x in e["fail_refs"] if x["ip"])
        assert [(x["ip"], x["count"]) for x in e["fail_ips_top"]] == counts.most_common(10)


def travel_loop(rows, window):
    out = []
    by_user = {}
    for i, r in enumerate(rows):
        if r[0] and r[5] and _py_ok(r[2], r[3]):
            by_user.setdefault(r[0], []).append((r[1], i + 1, r[5]))
    for user, evs in by_user.items():
        prev = None
        for ts, rn, c in sorted(evs):
            if prev and 0 <= ts - prev[0] <= window and c != prev[2]:
                out.append((user, rn))
            prev = (ts, rn, c)
    return sorted(out)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 200000), st.sampled_from(["ES", "US", ""])),
                min_size=1, max_size=50),
       st.sampled_from([3600, 7200, 86400]))
def test_travel_matches_loop_any_chunking(spark, evs, chunk):
    rows = [(u, ts, "0", "", "1.1.1.1", c, "app", "cli") for u, ts, c in evs]
    df = events(spark, rows)
    got = sorted((r["user"], int(r["rownum"])) for r in
                 sequence.det_impossible_travel(df, None, 60, chunk_seconds=chunk).collect())
    assert got == travel_loop(rows, 3600)


def asof_loop(signins, uals, window, last_n):
    out = []
    for (uid, user, ts) in uals:
        cands = sorted([s for s in signins if s[1] == user and s[2] <= ts], key=lambda s: (s[2], s[0]),
                       reverse=True)[:last_n]
        best = next((s for s in cands if s[3]), None)
        if best and 0 <= ts - best[2] <= window:
            out.append((uid, best[0]))
    return sorted(out)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40000), st.booleans()), max_size=40),
       st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 40000)), min_size=1, max_size=20),
       st.sampled_from([3600, 10000, 86400]))
def test_asof_matches_bruteforce(spark, sg, ua, chunk):
    s_rows = [(u, ts, "0" if ok else "50126", "", "1.1.1.1", "ES", "app", "cli") for u, ts, ok in sg]
    sdf = events(spark, s_rows) if s_rows else events(spark, [("z", 0, "0", "")]).limit(0)
    udf = spark.createDataFrame([(2, i + 1, ts, u, "op") for i, (u, ts) in enumerate(ua)],
                                "file_id long, rownum long, ts_epoch long, user string, operation string")
    got = sorted((int(r["ual_rownum"]), int(r["signin_ts"])) for r in
                 correlate.correlation_pairs_all(sdf, udf, 60, 5, chunk_seconds=chunk).collect())
    signins = [(i + 1, u, ts, ok) for i, (u, ts, ok) in enumerate(sg)]
    exp = asof_loop(signins, [(i + 1, u, ts) for i, (u, ts) in enumerate(ua)], 3600, 5)
    exp_ts = sorted((uid, next(s[2] for s in signins if s[0] == sid)) for uid, sid in exp)
    assert got == exp_ts


def test_hot_user_chunks_equal(spark):
    """A single hot user spread over many chunks gives the same findings as one big chunk."""
    rnd = random.Random(7)
    rows = [("hot", rnd.randint(0, 5 * 86400), "0", "", "1.1.1.1", rnd.choice(["ES", "US", "BR"]), "a", "c")
            for _ in range(400)]
    df = events(spark, rows)
    a = sorted(r["finding_id"] for r in sequence.det_impossible_travel(df, None, 60, chunk_seconds=3600).collect())
    b = sorted(r["finding_id"] for r in sequence.det_impossible_travel(df, None, 60, chunk_seconds=10 ** 7).collect())
    assert a == b and len(a) > 0


def test_building_saf_starts_no_job(spark):
    df = events(spark, [("a", 1, "0", "", "1.1.1.1", "ES", "a", "c")])
    spark.sparkContext.setJobGroup("saf", "building")
    sequence.det_success_after_failures(df, None, 30, 2)
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("saf")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_saf_hot_user_is_split(spark, monkeypatch):
    """One user with all rows, many levels of tables: the same findings as the loop, over many tasks."""
    monkeypatch.setattr(sequence, "FAN_IN", 4)
    monkeypatch.setattr(sequence, "LEVELS", 5)
    rnd = random.Random(3)
    rows = [("hot", 1000 + 11 * i, rnd.choice(["50126", "50126", "0"]), "", f"1.1.1.{i % 4}", "ES", "a", "c") for i in range(4000)]
    df = events(spark, rows)
    got = sorted((r["user"], int(r["rownum"]), int(r["details"].split(" ")[0])) for r in
                 sequence.det_success_after_failures(df, None, 30, 3, chunk_seconds=1800, segment_blocks=2).collect())
    assert got == saf_loop(rows, 1800, 3) and len(got) > 300
    early = sequence.saf_evidence(df, sequence.saf_emissions(df, 30, 3, 1800, 2), 30, 1800)
    assert early.select("n").agg({"n": "max"}).first()[0] <= 1800 // 11 + 1


def test_saf_storm_segments(spark):
    """Dense alternating storm (every success a candidate): segment chain equals the loop."""
    rows = []
    for i in range(300):
        rows.append(("hot", 1000 + 7 * i, "50126" if i % 3 else "0", "", "1.1.1.1", "ES", "a", "c"))
    df = events(spark, rows)
    for blocks in (1, 3, 1024):
        got = sorted((r["user"], int(r["rownum"]), int(r["details"].split(" ")[0])) for r in
                     sequence.det_success_after_failures(df, None, 30, 2, chunk_seconds=1800,
                                                         segment_blocks=blocks).collect())
        assert got == saf_loop(rows, 1800, 2), blocks
