"""A bounded cache for every key of a stream: least recently used entries go first, and entries age.

The state of a key is at most ``capacity`` entries (name, time of its last use,
time it was stored), kept in the checkpoint. An access hits if its entry is held
and was stored no longer than ``ttl_s`` seconds before; otherwise the entry is
stored anew. Without ageing the rule says the same as: an access hits if its name
was used before and fewer than ``capacity`` other names have been used since.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "names array<string>, stored array<double>"
OUT = "key long, event long, name string, hit boolean, evicted string"


def use(held: dict[str, float], name: str, at: float, capacity: int, ttl_s: float | None) -> tuple[bool, str | None]:
    """One access to a cache (least recently used first): whether it hits, and what it drives out."""
    stored = held.pop(name, None)
    hit = stored is not None and (ttl_s is None or at - stored <= ttl_s)
    held[name] = stored if hit else at
    gone = next(iter(held)) if len(held) > capacity else None
    if gone is not None:
        del held[gone]
    return hit, gone


def lru(rows: DataFrame, key: str, name: str, capacity: int, ttl_s: float | None = None, event: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, event, name, hit, evicted) for every access of a stream; those of one key and micro-batch are taken in order of time, then event."""
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.coalesce(F.col(name), F.lit("")).alias("name"), F.col(ts).cast("timestamp").cast("double").alias("at"))

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, stored = state.get if state.exists else ([], [])
        held = dict(zip(names, stored))
        frame = pd.concat(list(frames)).sort_values(["at", "event"])
        found = [use(held, n, at, capacity, ttl_s) for n, at in zip(frame["name"], frame["at"])]
        state.update((list(held), list(held.values())))
        yield pd.DataFrame({"key": keys[0], "event": frame["event"].to_numpy(), "name": frame["name"].to_numpy(), "hit": [h for h, _ in found], "evicted": [g for _, g in found]})

    return named.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)

