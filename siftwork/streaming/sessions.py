"""Session state over streams: rate limits, handles and quiet gaps, each the twin of a batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftwork import schema


def rate_limit(events: DataFrame, window: int = schema.RATE_WINDOW_MS, most: int = schema.RATE_MAX_SENDS) -> DataFrame:
    """(session, event_id, accepted) of a stream of events(session string, event_id long, ms long). State: times of the accepted that can still count, `most` at most.

    Events of a micro-batch are taken by time, then id; the stream is taken to bring a session's events in order from batch to batch.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"])
        out = []
        for now in rows["ms"].tolist():
            kept = [t for t in kept if now - t <= window]
            out.append(len(kept) < most)
            if out[-1]:
                kept.append(now)
        state.update((kept,))
        yield pd.DataFrame({"session": key[0], "event_id": rows["event_id"].to_numpy(), "accepted": out})

    return events.groupBy("session").applyInPandasWithState(step, "session string, event_id long, accepted boolean", "kept array<long>", "append", GroupStateTimeout.NoTimeout)


def handles(values: DataFrame) -> DataFrame:
    """(session, key, type, tier, handle) of a stream of values(session string, ord long, key string, type string, tier int): each normalized value once, numbered by first appearance."""

    def step(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = dict.fromkeys(state.get[0]) if state.exists else {}
        out = []
        for r in pd.concat(list(frames)).sort_values(["ord", "key"]).itertuples():
            if r.key not in seen:
                seen[r.key] = None
                out.append((group[0], r.key, r.type, r.tier, f"⟦{r.type}⟧" if r.tier == 1 else f"⟦{r.type}#{len(seen)}⟧"))
        state.update((list(seen),))
        yield pd.DataFrame(out, columns=["session", "key", "type", "tier", "handle"])

    return values.groupBy("session").applyInPandasWithState(step, "session string, key string, type string, tier int, handle string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def quiet(events: DataFrame, gap: str = "150 milliseconds", late: str = "2 seconds") -> DataFrame:
    """(session, start, end, n): stretches of a stream of events(session, ts) closed by a gap; events later than `late` are left out."""
    found = events.withWatermark("ts", late).groupBy("session", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
