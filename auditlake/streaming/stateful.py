"""Keyed state of the streaming detectors: processors for ``transformWithState``.

State lies in small entries (RocksDB), one per distinct value or per piece of
an hour of waiting rows, so that a batch touches what it changes and not all
that a key holds.  Event-time timers remove it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CAMPAIGN_OUT = "key string, bucket long, fails long, n_other long, min_ts long, max_ts long"
SAF_OUT = "user string, ts_epoch long, file_id long, rownum long, ip string, fail_count long"
#: Seconds, and rows, of waiting rows that an entry holds at most.
SLOT, ENTRY_ROWS = 3600, 4096


def use_keyed_state(spark: SparkSession) -> None:
    """Streams started in this session from now on keep their state in RocksDB, as ``transformWithState`` asks."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _campaign_rows(rows: list[tuple]) -> pd.DataFrame:
    names = [f.split()[0] for f in CAMPAIGN_OUT.split(", ")]
    return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if i else object) for i, n in enumerate(names)})


class CampaignCounts(StatefulProcessor):
    """Failures and distinct other values of each (key, bucket): counters, and an entry per distinct value."""

    def __init__(self, window: int, min_failures: int, min_other: int):
        self.window, self.min_failures, self.min_other = window, min_failures, min_other

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", "fails long, n_other long, min_ts long, max_ts long")
        self.others = handle.getMapState("others", "other string", "seen boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.counts.get() if self.counts.exists() else None
        fails, n_other, low, high = known or (0, 0, None, None)
        for pdf in rows:
            fails += len(pdf)
            least, most = int(pdf["ts_epoch"].min()), int(pdf["ts_epoch"].max())
            low, high = least if low is None else min(low, least), most if high is None else max(high, most)
            for other in pdf["other"].unique():
                if not self.others.containsKey((other,)):
                    self.others.updateValue((other,), (True,))
                    n_other += 1
        self.counts.update((fails, n_other, low, high))
        self.handle.registerTimer((int(key[1]) + 1) * self.window * 1000)
        hit = fails >= self.min_failures and n_other >= self.min_other
        yield _campaign_rows([(key[0], int(key[1]), fails, n_other, low, high)][:hit])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.counts.clear()
        self.others.clear()
        yield _campaign_rows([])

    def close(self) -> None:
        pass


def emissions(fails: np.ndarray, at: np.ndarray, before: np.ndarray, window: int, min_fails: int) -> list[tuple[int, int]]:
    """(index, failures) of the successes that end a run of failures.

    ``fails`` are sorted failure times; success i happens at ``at[i]`` after
    the first ``before[i]`` of them.  It counts those inside the window that no
    earlier emission has used up.
    """
    out, used = [], 0
    oldest = np.searchsorted(fails, at - window, side="left")
    for i in np.flatnonzero(before - oldest >= min_fails):
        n = int(before[i] - max(oldest[i], used))
        if n >= min_fails:
            out.append((int(i), n))
            used = int(before[i])
    return out


class SuccessAfterFailures(StatefulProcessor):
    """Rows wait in entries of an hour until the watermark has passed them; the live failures of a user are a list.

    A batch adds entries and reads none.  A user has one timer: at its first
    waiting row, which brings on all that is due then, or, while nothing waits,
    behind its last failure, which clears the list.
    """

    COLUMNS = ["ts_epoch", "file_id", "rownum", "f", "ip"]

    def __init__(self, window: int, min_fails: int):
        self.window, self.min_fails = window, min_fails

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "slot long, part long", "low long, ts_epoch array<long>, file_id array<long>, "
                                                                             "rownum array<long>, f array<boolean>, ip array<string>")
        self.known = handle.getValueState("known", "parts long, timer long")
        self.fails = handle.getListState("fails", "ts long")

    def _put(self, rows: pd.DataFrame, parts: int) -> int:
        """Stores rows in entries numbered from ``parts`` on; the next free number."""
        rows = rows.sort_values("ts_epoch", kind="stable")
        columns = [rows[c].tolist() for c in self.COLUMNS]
        slots = rows["ts_epoch"].to_numpy(np.int64) // SLOT
        edges = [0, *(np.flatnonzero(np.diff(slots)) + 1).tolist(), len(rows)]
        for start, stop in zip(edges, edges[1:]):
            for at in range(start, stop, ENTRY_ROWS):
                own = [c[at:min(at + ENTRY_ROWS, stop)] for c in columns]
                self.waiting.updateValue((int(slots[at]), parts), (own[0][0], *own))
                parts += 1
        return parts

    def _set_timer(self, parts: int, old: int | None, new: int) -> None:
        """Keeps one timer, at the second ``new``."""
        if old != new:
            if old is not None:
                self.handle.deleteTimer(old * 1000)
            self.handle.registerTimer(new * 1000)
        self.known.update((parts, new))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat([p[self.COLUMNS] for p in rows])
        parts, timer = tuple(self.known.get()) if self.known.exists() else (0, None)
        first = int(new["ts_epoch"].min())
        self._set_timer(self._put(new, parts), timer, first if timer is None else min(timer, first))
        yield self._out(key, new[:0], [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() // 1000
        parts = int(self.known.get()[0])
        ready, later = [pd.DataFrame({c: [] for c in self.COLUMNS})], []
        for slot, part in sorted(tuple(k) for k in self.waiting.keys()):
            if slot * SLOT > passed:
                later.append((slot, part))
                continue
            held = pd.DataFrame({c: list(v) for c, v in zip(self.COLUMNS, self.waiting.getValue((slot, part))[1:])})
            due = held["ts_epoch"] <= passed
            if not due.any():
                later.append((slot, part))
                continue
            ready.append(held[due])
            self.waiting.removeKey((slot, part))
            if not due.all():
                later.append((slot, parts))
                parts = self._put(held[~due], parts)
        rows = pd.concat([r for r in ready if len(r)] or ready).astype({"ts_epoch": "int64", "file_id": "int64", "rownum": "int64", "f": bool})
        rows = rows.sort_values(["ts_epoch", "file_id", "rownum"], kind="stable", ignore_index=True)
        live = np.array([int(x[0]) for x in self.fails.get()] if self.fails.exists() else [], np.int64)
        failed = rows["f"].to_numpy(bool)
        fails = np.concatenate([live, rows["ts_epoch"].to_numpy(np.int64)[failed]])
        good = rows[~failed]
        before = len(live) + np.cumsum(failed)[~failed]
        found = emissions(fails, good["ts_epoch"].to_numpy(np.int64), before, self.window, self.min_fails)
        used = int(before[found[-1][0]]) if found else 0
        left = fails[used:][fails[used:] > passed - self.window]  # older ones can meet no later event
        if len(left) < len(live) or used:
            if len(left):
                self.fails.put([(int(x),) for x in left])
            else:
                self.fails.clear()
        elif len(left) > len(live):
            self.fails.appendList([(int(x),) for x in left[len(live):]])
        if later:
            first = later[0][0]  # entries of one slot, the first that waits, tell the row that is due next
            after = min(int(self.waiting.getValue(k)[0]) for k in later if k[0] == first)
        else:
            after = int(left[-1]) + self.window + 1 if len(left) else None
        if after is None:
            self.known.clear()
        else:  # the timer that expired is gone after this call
            self._set_timer(parts, None, after)
        yield self._out(key, good.iloc[[i for i, _ in found]], [n for _, n in found])

    def _out(self, key, rows: pd.DataFrame, counts: list[int]) -> pd.DataFrame:
        out = {c: pd.Series(rows[c].tolist(), dtype="int64") for c in ("ts_epoch", "file_id", "rownum")}
        return pd.DataFrame({"user": pd.Series([key[0]] * len(rows), dtype=object), **out, "ip": pd.Series(rows["ip"].tolist(), dtype=object),
                             "fail_count": pd.Series(counts, dtype="int64")})

    def close(self) -> None:
        pass
