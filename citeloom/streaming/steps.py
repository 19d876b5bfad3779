"""Per-key state machines shared by the batch replay and the streaming operators.

A machine folds one event into a small JSON-able state and returns its verdict.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

US = 1_000_000
DAY = 86_400 * US


@dataclass(frozen=True)
class Machine:
    """``fold(state, ts_us, ok) -> (state, verdict)``; ``reset_after`` is the idle gap that forgets all state."""

    start: dict
    fold: Callable[[dict, int, bool], tuple[dict, dict]]
    reset_after: int | None


def admission(per_minute: int = 60, per_hour: int = 1000, per_day: int = 10000) -> Machine:
    """Only admitted requests enter the windows; minute, hour, then day decide."""

    def fold(state: dict, ts: int, ok: bool) -> tuple[dict, dict]:
        seen = state["seen"]
        seen = seen[bisect_right(seen, ts - DAY):]
        within = lambda w: len(seen) - bisect_right(seen, ts - w)
        reason = ""
        if within(60 * US) >= per_minute:
            reason = "minute"
        elif within(3600 * US) >= per_hour:
            reason = "hour"
        elif len(seen) >= per_day:
            reason = "day"
        return {"seen": seen if reason else [*seen, ts]}, {"allowed": not reason, "reason": reason}

    return Machine({"seen": []}, fold, DAY)


def token_bucket(rate: float, burst: int, cost: int = 1) -> Machine:
    """tokens = min(burst, tokens + elapsed * rate); allowed while tokens cover the cost."""

    def fold(state: dict, ts: int, ok: bool) -> tuple[dict, dict]:
        last = state["last"]
        tokens = float(burst) if last is None else min(float(burst), state["tokens"] + (ts - last) / US * rate)
        allowed = tokens >= cost
        retry = 0.0 if allowed else (cost - tokens) / rate
        return {"tokens": tokens - cost if allowed else tokens, "last": ts}, {"allowed": allowed, "retry_after": retry}

    return Machine({"tokens": float(burst), "last": None}, fold, int(burst / rate * US) + 1)


def combined_limiter(per_minute: int = 60, per_hour: int = 1000, burst: int = 10) -> Machine:
    """Burst bucket, then minute and hour windows; a burst token is spent even if a window rejects."""
    bucket = token_bucket(per_minute / 60.0, burst)
    windows = admission(per_minute, per_hour, 10**12)

    def fold(state: dict, ts: int, ok: bool) -> tuple[dict, dict]:
        b, burst_verdict = bucket.fold(state["bucket"], ts, ok)
        if not burst_verdict["allowed"]:
            return {"bucket": b, "windows": state["windows"]}, {"allowed": False, "reason": "burst"}
        w, verdict = windows.fold(state["windows"], ts, ok)
        return {"bucket": b, "windows": w}, verdict

    return Machine({"bucket": bucket.start, "windows": windows.start}, fold, DAY)


def circuit_breaker(threshold: int = 5, recovery: int = 30, trial_calls: int = 3) -> Machine:
    """closed -> open after failures, half-open after the recovery time, closed after enough successes.

    Successes never lower the failure count while closed; half-open closes on the
    success count kept since the last reset.
    """

    def fold(state: dict, ts: int, ok: bool) -> tuple[dict, dict]:
        s = dict(state)
        if s["state"] == "open" and ts - s["opened"] >= recovery * US:
            s.update(state="half_open", trials=0)
        if s["state"] == "open" or (s["state"] == "half_open" and s["trials"] >= trial_calls):
            return s, {"allowed": False, "state": s["state"]}
        if s["state"] == "half_open":
            s["trials"] += 1
        if ok:
            s["successes"] += 1
            if s["state"] == "half_open" and s["successes"] >= trial_calls:
                s.update(state="closed", failures=0, successes=0, opened=None)
        else:
            s["failures"] += 1
            if s["state"] == "half_open" or s["failures"] >= threshold:
                s.update(state="open", opened=ts)
        return s, {"allowed": True, "state": s["state"]}

    return Machine({"state": "closed", "failures": 0, "successes": 0, "trials": 0, "opened": None}, fold, None)
