"""The triage plan: all detectors in fixed order over normalised tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..functions import constants as K
from ..operators import campaigns, correlate, findings as FN, row_detectors, rules as R, sequence
from ..operators.sequence import DEFAULT_CHUNK_SECONDS


@dataclass(frozen=True)
class TriageParams:
    """Detector parameters; defaults are the reference's."""
    mode: str = "deep"
    spray_window: int = 15
    spray_min_failures: int = 20
    spray_min_users: int = 5
    brute_window: int = 15
    brute_min_failures: int = 25
    brute_min_ips: int = 5
    saf_minutes: int = 30
    saf_min_fails: int = 5
    travel_minutes: int = 60
    spike_window: int = 60
    spike_threshold: int = 500
    spike_require_context: bool = False
    corr_minutes: int = 60
    corr_last_n: int = 5
    campaign_top: int | None = None
    chunk_seconds: int = DEFAULT_CHUNK_SECONDS


# Thresholds used on the thin 30-day test tables (FIXTURES.md); defaults stay in TriageParams.
TEST_PARAMS = TriageParams(
    spray_window=360, spray_min_failures=6, spray_min_users=4,
    brute_window=360, brute_min_failures=6, brute_min_ips=4,
    saf_minutes=120, saf_min_fails=3,
    spike_window=360, spike_threshold=2,
)

DETECTOR_ORDER = ["risky_signin", "legacy_auth", "password_spray", "bruteforce", "success_after_failures",
                  "impossible_travel", "ual_suspicious", "mailitems_spike", "correlation", "rules"]


def detector_frames(signin: DataFrame, ual: DataFrame, files: DataFrame | None = None, rules=None,
                    params: TriageParams = TriageParams()) -> list[tuple[int, DataFrame]]:
    p = params
    out = [
        (3, campaigns.det_password_spray(signin, p.spray_window, p.spray_min_failures, p.spray_min_users,
                                         p.campaign_top)),
        (4, campaigns.det_bruteforce(signin, p.brute_window, p.brute_min_failures, p.brute_min_ips,
                                     p.campaign_top)),
        (5, sequence.det_success_after_failures(signin, files, p.saf_minutes, p.saf_min_fails, p.chunk_seconds)),
        (6, sequence.det_impossible_travel(signin, files, p.travel_minutes, p.chunk_seconds)),
    ]
    if p.mode != "quick":
        out.append((8, campaigns.det_mailitems_spike(ual, p.spike_window, p.spike_threshold,
                                                     p.spike_require_context, p.campaign_top)))
        out.append((9, correlate.det_correlation(signin, ual, files, p.corr_minutes, p.corr_last_n,
                                                 p.chunk_seconds)))
    return out


def detect_all(signin: DataFrame, ual: DataFrame, files: DataFrame | None = None, rules=None,
               params: TriageParams = TriageParams()) -> DataFrame:
    """``union_findings``: every detector output with its ``detector_no``.

    Row-level detectors and rules share one pass per table (risky, legacy
    and sign-in rules over ``signin``; suspicious operations and audit rules
    over ``ual``); the other detectors are separate plans.
    """
    fused = (row_detectors.fused_signin_findings(signin, files, rules)
             .unionByName(row_detectors.fused_ual_findings(ual, files, rules)))
    rest = FN.union_findings(detector_frames(signin, ual, files, rules, params))
    return fused.unionByName(rest)


def quick(params: TriageParams) -> TriageParams:
    return replace(params, mode="quick")
