"""Ordered per-user detectors.

``det_impossible_travel`` — previous successful geolocated sign-in (lag).
``det_success_after_failures`` — success after >= N failures inside a
trailing window, with the failure list cleared after each emission.

Hot users: the travel lag only matters within ``max_minutes``, so rows are
partitioned by (user, time chunk) and the last ``max_minutes`` of the
previous chunk are copied in as a read-only halo.  A user holding a third of
all rows is therefore spread over as many tasks as it has chunks, and the
result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import predicates as P
from ..functions.text import concat_str, nz, ref
from ..schema import finding
from .lookup import with_file_sha

DEFAULT_CHUNK_SECONDS = 6 * 3600


def with_halo(df: DataFrame, ts: str, chunk_seconds: int, halo_seconds: int) -> DataFrame:
    """Add ``_chunk`` (= floor(ts / chunk)) and copy rows lying within ``halo_seconds``
    before the next chunk start into that chunk with ``_halo = true``."""
    L = int(chunk_seconds)
    H = int(halo_seconds)
    if H > L:
        raise ValueError("halo must not exceed the chunk length")
    base = F.floor(F.col(ts) / F.lit(L)).cast("long")
    nxt = (base + 1) * F.lit(L)
    offs = F.when(F.col(ts) >= nxt - F.lit(H), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (df.withColumn("_off", F.explode(offs))
            .withColumn("_chunk", base + F.col("_off"))
            .withColumn("_halo", F.col("_off") == 1)
            .drop("_off"))


def chunk_of(ts: str, chunk_seconds: int) -> Column:
    return F.floor(F.col(ts) / F.lit(int(chunk_seconds))).cast("long")


# -- impossible travel ---------------------------------------------------------

def det_impossible_travel(signin: DataFrame, files: DataFrame | None = None, max_minutes: int = 60,
                          chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """Consecutive successful geolocated sign-ins of one user from different countries
    within ``max_minutes``."""
    cat, title = K.FINDING_META["impossible_travel"]
    W = int(max_minutes) * 60
    L = max(int(chunk_seconds), W)
    rows = (signin
            .filter((nz("user") != "") & F.col("ts_epoch").isNotNull() & (nz("country") != "") & P.signin_success())
            .select("user", "ts_epoch", "file_id", "rownum", "country", "ip", "ts_iso"))
    h = with_halo(rows, "ts_epoch", L, W)
    w = Window.partitionBy("user", "_chunk").orderBy("ts_epoch", "file_id", "rownum")
    prev = F.lag(F.struct("ts_epoch", "country", "ip", "file_id", "rownum", "ts_iso")).over(w)
    hits = (h.withColumn("_prev", prev)
            .filter(~F.col("_halo") & F.col("_prev").isNotNull())
            .withColumn("_dt", F.col("ts_epoch") - F.col("_prev.ts_epoch"))
            .filter((F.col("_dt") >= 0) & (F.col("_dt") <= W) & (F.col("country") != F.col("_prev.country"))))
    hits = with_file_sha(hits, files)
    details = concat_str("Successful sign-in from ", F.col("_prev.country"), " -> ", F.col("country"), " in ",
                         F.expr("_dt div 60").cast("string"), "m")
    evidence = F.struct(
        F.struct(F.col("_prev.ts_iso").alias("ts"), F.col("_prev.country").alias("country"),
                 F.col("_prev.ip").alias("ip"), ref("_prev.file_id", "_prev.rownum").alias("ref")).alias("prev"),
        F.struct(F.col("ts_iso").alias("ts"), F.col("country"), F.col("ip"),
                 ref("file_id", "rownum").alias("ref")).alias("now"),
        F.col("_dt").alias("delta_seconds"))
    fid = concat_str("IMPTRAVEL-", F.col("user"), "-", F.col("file_id").cast("string"), "-",
                     F.col("rownum").cast("string"), "-", F.col("ts_epoch").cast("string"))
    return finding(hits, finding_id=fid, severity="high", category=cat, title=title, timestamp=F.col("ts_iso"),
                   user=F.col("user"), ip=F.col("ip"), country=F.col("country"),
                   file=F.col("file_id").cast("string"), rownum=F.col("rownum").cast("string"),
                   sha256=F.col("sha256"), details=details, evidence=evidence)


# -- success after failures ------------------------------------------------------

def saf_candidate_users(signin: DataFrame, min_fails: int) -> DataFrame:
    """Users with >= ``min_fails`` failures and >= 1 success (SQL flavour): ``semi_saf_users``."""
    base = signin.filter((nz("user") != "") & F.col("ts_epoch").isNotNull())
    return (base.groupBy("user")
            .agg(F.sum(F.when(P.sql_failure(), 1).otherwise(0)).alias("_nf"),
                 F.sum(F.when(P.sql_success(), 1).otherwise(0)).alias("_ns"))
            .filter((F.col("_nf") >= min_fails) & (F.col("_ns") >= 1))
            .select("user"))


#: Segments whose tables one group composes, and levels of such groups below the last one.
FAN_IN, LEVELS = 1024, 1


def _entries(tables: DataFrame, m: int, levels: int) -> DataFrame:
    """(user, _g, _entry): with which offset the emission threshold enters each segment.

    ``tables`` has (user, _g, _tab): for each entry offset in [0, m) the one
    with which the threshold leaves segment _g; segments without candidates
    are absent, and an offset never outlives one.  FAN_IN neighbouring tables
    compose to one, level by level; a user's tables of the last level, each
    for FAN_IN ** levels segments, are followed from the first on, and the
    offsets then handed down.
    """
    def run(blocks: DataFrame, first, entry):
        """Array of (g, entry) over the sorted ``_tabs``, and the offset and number of the last one's exit."""
        start = F.struct((first - 1).cast("long").alias("g"), entry.cast("long").alias("off"),
                         F.array().cast("array<struct<g:bigint,entry:bigint>>").alias("seen"))

        def step(acc, t):
            enters = F.when(t["_g"] == acc["g"] + 1, acc["off"]).otherwise(F.lit(0).cast("long"))
            return F.struct(t["_g"].alias("g"), F.element_at(t["_tab"], (enters + 1).cast("int")).alias("off"),
                            F.concat(acc["seen"], F.array(F.struct(t["_g"].alias("g"), enters.alias("entry")))).alias("seen"))

        return F.aggregate("_tabs", start, step)

    group = F.floor(F.col("_g") / FAN_IN).cast("long") if levels else F.lit(0).cast("long")
    blocks = tables.groupBy("user", group.alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_g", "_tab"))).alias("_tabs"))
    if levels:
        first, last = F.col("_block") * FAN_IN, (F.col("_block") + 1) * FAN_IN - 1

        def leaves(offset: int):
            end = run(blocks, first, F.lit(offset))
            return F.when(end["g"] == last, end["off"]).otherwise(F.lit(0).cast("long"))

        above = blocks.select("user", F.col("_block").alias("_g"), F.array(*[leaves(o) for o in range(m)]).alias("_tab"))
        blocks = blocks.join(_entries(above, m, levels - 1).withColumnRenamed("_g", "_block"), ["user", "_block"])
        seen = run(blocks, first, F.col("_entry"))["seen"]
    else:
        seen = run(blocks, F.lit(-1), F.lit(0))["seen"]
    return blocks.select("user", F.explode(seen).alias("_e")).select("user", F.col("_e.g").alias("_g"), F.col("_e.entry").alias("_entry"))


def _emitting(cands: DataFrame, m: int, blocks: int) -> DataFrame:
    """(user, s): the candidates (user, s) that emit, a greedy chain over their failure counts ``s.C``, in segments.

    Emissions are the chain x1 = min X, x_{k+1} = min{x in X : x >= x_k + m}
    over the distinct counts X of valid candidates (the first candidate with a
    given count represents it).  The count axis is cut into segments of
    ``blocks * m`` values: what a segment does to the chain depends only on the
    offset of the threshold at its begin, in [0, m), so a table of m entries
    sums it up (:func:`_entries`).
    """
    seg_len = m * int(blocks)
    reps = cands.groupBy("user", F.col("s.C").alias("_C")).agg(F.min("s").alias("s"))
    segs = reps.groupBy("user", F.floor(F.col("_C") / F.lit(seg_len)).cast("long").alias("_g")).agg(
        F.array_sort(F.collect_list(F.struct("_C", "s"))).alias("_xs"))
    base, following = F.col("_g") * seg_len, (F.col("_g") + 1) * seg_len

    def leaves(offset: int):
        end = F.aggregate("_xs", (base + offset).cast("long"), lambda th, x: F.when(x["_C"] >= th, x["_C"] + m).otherwise(th))
        return F.greatest(end - following, F.lit(0)).cast("long")

    tables = segs.select("user", "_g", F.array(*[leaves(o) for o in range(m)]).alias("_tab"))
    entered = segs.join(_entries(tables, m, LEVELS), ["user", "_g"])
    kept_t = entered.schema["_xs"].dataType.simpleString()
    start = F.struct((base + F.col("_entry")).cast("long").alias("th"), F.array().cast(kept_t).alias("kept"))
    chain = F.aggregate("_xs", start, lambda acc, x: F.when(x["_C"] >= acc["th"], F.struct(
        (x["_C"] + m).alias("th"), F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc))
    return entered.select("user", F.explode(chain["kept"]).alias("_x")).select("user", "_x.s")


def saf_emissions(signin: DataFrame, max_minutes: int = 30, min_fails: int = 5, chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
                  segment_blocks: int = 1024) -> DataFrame:
    """(user, s): the successes that emit (exact reference semantics).

    Let C(r) be the number of failures before row r (user order) and inwin(s)
    the number of failures in the window before success s.  Success s emits
    iff inwin(s) >= m and C(s) - C(E) >= m, where E is the previous emission.
    C and inwin come from windows over (user, time chunk) partitions with a
    halo of one window, plus the failures of earlier chunks from a table with
    a row per chunk, so a hot user is split by time.
    """
    W = int(max_minutes) * 60
    m = int(min_fails)
    L = max(int(chunk_seconds), W)
    users = saf_candidate_users(signin, m)
    rows = (signin.filter((nz("user") != "") & F.col("ts_epoch").isNotNull())
            .join(users, "user", "left_semi")
            .withColumn("_f", P.signin_failure())
            .withColumn("_s", ~F.col("_f") & P.signin_success())
            .filter(F.col("_f") | F.col("_s"))
            .select("user", "ts_epoch", "file_id", "rownum", "_f", nz("ip").alias("ip"), nz("country").alias("country"),
                    nz("app").alias("app"), nz("client_app").alias("client_app"),
                    nz("error_code").alias("error_code"), nz("ts_iso").alias("ts_iso")))
    per_chunk = rows.groupBy("user", chunk_of("ts_epoch", L).alias("_chunk")).agg(F.sum(F.col("_f").cast("long")).alias("_nf"))
    earlier = Window.partitionBy("user").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    per_chunk = per_chunk.select("user", "_chunk", F.coalesce(F.sum("_nf").over(earlier), F.lit(0)).alias("_carried"))
    h = with_halo(rows, "ts_epoch", L, W)
    part = Window.partitionBy("user", "_chunk")
    w = part.orderBy("ts_epoch", "file_id", "rownum").rowsBetween(Window.unboundedPreceding, -1)
    older = part.orderBy("ts_epoch").rangeBetween(Window.unboundedPreceding, -(W + 1))
    h = (h.withColumn("_before", F.coalesce(F.sum(F.col("_f").cast("long")).over(w), F.lit(0)))
         .withColumn("_own", F.coalesce(F.sum((F.col("_f") & ~F.col("_halo")).cast("long")).over(w), F.lit(0)))
         .withColumn("_inwin", F.col("_before") - F.coalesce(F.sum(F.col("_f").cast("long")).over(older), F.lit(0)))
         .filter(~F.col("_halo") & ~F.col("_f") & (F.col("_inwin") >= m)))
    cands = h.join(per_chunk, ["user", "_chunk"])
    s = F.struct(F.col("ts_epoch").alias("ts"), "file_id", "rownum", (F.col("_carried") + F.col("_own")).alias("C"),
                 "ip", "country", "app", "client_app", "error_code", "ts_iso")
    return _emitting(cands.select("user", s.alias("s")), m, segment_blocks)


def saf_evidence(signin: DataFrame, emissions: DataFrame, max_minutes: int = 30, chunk_seconds: int = DEFAULT_CHUNK_SECONDS) -> DataFrame:
    """(user, s, n, ips, refs) of each emission: the failures it used up, their commonest addresses, the first references.

    A failure belongs to the user's next emission, if that follows within the
    window; one window over (user, time chunk) with a halo tells which it is.
    All later steps group within these partitions, and none holds more than
    the references and addresses that are kept.
    """
    W = int(max_minutes) * 60
    L = max(int(chunk_seconds), W)
    key = ["ts", "file_id", "rownum"]
    fails = (signin.filter((nz("user") != "") & F.col("ts_epoch").isNotNull() & P.signin_failure())
             .select("user", F.col("ts_epoch").alias("ts"), "file_id", "rownum", nz("ip").alias("_ip")))
    em = emissions.select("user", "s.ts", "s.file_id", "s.rownum", "s")
    both = fails.unionByName(em, allowMissingColumns=True)
    # newest first, so that the running last one is the next in time
    w = Window.partitionBy("user", "_chunk").orderBy(*[F.desc(c) for c in key]).rowsBetween(Window.unboundedPreceding, 0)
    own = F.when(F.col("s").isNotNull(), F.struct(*key, "_halo"))
    rows = with_halo(both, "ts", L, W).withColumn("_e", F.last(own, ignorenulls=True).over(w))
    rows = rows.filter(F.col("_e").isNotNull() & ~F.col("_e._halo") & F.when(F.col("s").isNull(), F.col("ts") >= F.col("_e.ts") - W).otherwise(
        (F.col("s.ts") == F.col("_e.ts")) & (F.col("s.file_id") == F.col("_e.file_id")) & (F.col("s.rownum") == F.col("_e.rownum"))))
    of = ["user", "_chunk", "_e"]
    rank = F.row_number().over(Window.partitionBy(*of).orderBy(F.col("s").isNotNull(), *key))
    ref_ = F.struct("ts", F.col("_ip").alias("ip"), ref("file_id", "rownum").alias("ref"), "file_id", "rownum")
    rows = rows.withColumn("_ref", F.when(F.col("s").isNull() & (rank <= K.SAF_REFS), ref_))
    per_ip = rows.groupBy(*of, "_ip").agg(F.count(F.when(F.col("s").isNull(), 1)).alias("_n"), F.min(F.struct(*key)).alias("_first"),
                                          F.collect_list("_ref").alias("_refs"), F.max("s").alias("s"))
    named = F.coalesce(F.col("_ip") != "", F.lit(False))
    place = F.row_number().over(Window.partitionBy(*of).orderBy(F.desc(named), F.desc("_n"), "_first"))
    top = F.struct(place.alias("place"), F.col("_ip").alias("ip"), F.col("_n").alias("count"))
    per_ip = per_ip.withColumn("_top", F.when(named & (place <= K.SAF_TOP_IPS), top))
    out = per_ip.groupBy(*of).agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list("_top")).alias("_tops"),
                                  F.array_sort(F.flatten(F.collect_list("_refs"))).alias("_all"), F.max("s").alias("s"))
    return out.select("user", "s", "n", F.transform("_tops", lambda t: F.struct(t["ip"].alias("ip"), t["count"].alias("count"))).alias("ips"),
                      F.transform("_all", lambda x: F.struct(x["ts"].alias("ts"), x["ip"].alias("ip"), x["ref"].alias("ref"))).alias("refs"))


def det_success_after_failures(signin: DataFrame, files: DataFrame | None = None, max_minutes: int = 30,
                               min_fails: int = 5, chunk_seconds: int = DEFAULT_CHUNK_SECONDS,
                               segment_blocks: int = 1024) -> DataFrame:
    """Success after at least ``min_fails`` failures within ``max_minutes``; the failures count once."""
    cat, title = K.FINDING_META["success_after_failures"]
    em = saf_emissions(signin, max_minutes, min_fails, chunk_seconds, segment_blocks)
    flat = with_file_sha(saf_evidence(signin, em, max_minutes, chunk_seconds).select("user", "n", "ips", "refs", "s.*"), files)
    hint = P.error_hint(F.col("error_code"))
    details = concat_str(F.col("n").cast("string"), f" failures then success within {max_minutes}m; success_ip=",
                         F.col("ip"), " app=", F.col("app"), " client=", F.col("client_app"),
                         F.when(hint.isNotNull(), F.concat(F.lit(" ("), hint, F.lit(")"))).otherwise(F.lit("")))
    evidence = F.struct(
        F.col("n").alias("fail_count"), F.col("ips").alias("fail_ips_top"), F.col("refs").alias("fail_refs"),
        F.struct(F.col("file_id"), F.col("rownum"), F.col("ip"), F.col("app"), F.col("client_app")).alias("success"),
        F.lit(int(max_minutes)).alias("window_minutes"))
    fid = concat_str("SAF-", F.col("user"), "-", F.col("file_id").cast("string"), "-",
                     F.col("rownum").cast("string"), "-", F.col("ts").cast("string"))
    return finding(flat, finding_id=fid, severity="high", category=cat, title=title, timestamp=F.col("ts_iso"),
                   user=F.col("user"), ip=F.col("ip"), country=F.col("country"),
                   file=F.col("file_id").cast("string"), rownum=F.col("rownum").cast("string"),
                   sha256=F.col("sha256"), details=details, evidence=evidence)
