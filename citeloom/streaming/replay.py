"""Exact batch replay of order-dependent machines."""

from __future__ import annotations

import copy
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from citeloom.operators import ordered

from .steps import US, Machine


def replay(events: DataFrame, machine: Machine, verdicts: str, key: str = "key_id", event_id: str = "event_id", ts: str = "ts", ok: str | None = None) -> DataFrame:
    """Verdict of every event: ``(key, event_id, *verdicts)``.

    A key's timeline is cut where an idle gap is long enough to forget all state;
    the pieces run in parallel. A piece streams through its task in Arrow batches
    with the machine's small state carried along, so no piece is ever gathered.
    """
    rows = events.select(key, event_id, F.col(ts).alias("_ts"), (F.col(ok) if ok else F.lit(True)).alias("_ok"))
    if machine.reset_after is None:
        rows = rows.withColumn("_seg", F.lit(0))
    else:
        day = lambda: F.to_date("_ts")
        gaps = ordered.previous_value(rows, [key], ["_ts", event_id], day(), "_ts", "_prev")
        fresh = F.when((ordered.epoch_micros(F.col("_ts")) - ordered.epoch_micros(F.col("_prev"))) >= machine.reset_after, 1).otherwise(0)
        rows = ordered.running_sums(gaps.withColumn("_fresh", fresh), [key], ["_ts", event_id], day(), {"_seg": F.col("_fresh")})
    rows = rows.select(key, event_id, "_seg", ordered.epoch_micros(F.col("_ts")).alias("_us"), "_ok")
    sorted_rows = rows.repartition(key, "_seg").sortWithinPartitions(key, "_seg", "_us", event_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            for k, e, seg, us, good in zip(batch[key], batch[event_id], batch["_seg"], batch["_us"], batch["_ok"]):
                if (k, seg) != current:
                    current, state = (k, seg), copy.deepcopy(machine.start)
                state, verdict = machine.fold(state, int(us), bool(good))
                out.append({key: k, event_id: e, **verdict})
            if out:
                yield pd.DataFrame(out)

    return sorted_rows.mapInPandas(run, f"{key} bigint, {event_id} bigint, {verdicts}")


def sustained_spans(samples: DataFrame, keys: list[str], ts: str, hot: str, hold_seconds: int, bucket) -> DataFrame:
    """Gaps-and-islands twin of the sustained alert: runs of hot samples lasting at least the hold time."""
    prev = ordered.previous_value(samples, keys, [ts], bucket(), hot, "_prev")
    starts = F.when(F.col(hot) & ~F.coalesce("_prev", F.lit(False)), 1).otherwise(0)
    runs = ordered.running_sums(prev.withColumn("_start", starts), keys, [ts], bucket(), {"_run": F.col("_start")})
    spans = runs.filter(F.col(hot)).groupBy(*keys, "_run").agg(F.min(ts).alias("since"), F.max(ts).alias("until"))
    held = ordered.epoch_micros(F.col("until")) - ordered.epoch_micros(F.col("since"))
    return spans.filter(held >= hold_seconds * US).select(*keys, "since", "until")
