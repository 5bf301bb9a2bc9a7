"""State over streams: budgets, circuit breakers, a table that is read again each batch, and merges of partial states.

Each operator takes a stream or a table. A stream keeps one small state a key,
in the checkpoint; a table is answered by a window over each key's events.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def budget(rows: DataFrame, key: str, limit: int, event: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, event, n, allowed): an event's number among those of its key, and whether it is within ``limit``."""
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.col(ts).alias("ts"))
    if not rows.isStreaming:
        n = F.row_number().over(Window.partitionBy("key").orderBy("ts", "event")).cast("long")
        return named.select("key", "event", n.alias("n"), (n <= limit).alias("allowed"))

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        frame = pd.concat(list(frames)).sort_values(["ts", "event"])
        n = seen + 1 + pd.RangeIndex(len(frame)).to_numpy()
        state.update((seen + len(frame),))
        yield pd.DataFrame({"key": keys[0], "event": frame["event"].to_numpy(), "n": n, "allowed": n <= limit})

    return named.groupBy("key").applyInPandasWithState(step, "key long, event long, n long, allowed boolean", "seen long", "append", GroupStateTimeout.NoTimeout)


def breaker(rows: DataFrame, key: str, failed: Column, limit: int = 3, event: str = "event_id", ts: str = "ts") -> DataFrame:
    """(key, event, open): whether the last ``limit`` events of the key before this one all failed."""
    named = rows.select(F.col(key).cast("long").alias("key"), F.col(event).cast("long").alias("event"), F.col(ts).alias("ts"), F.coalesce(failed, F.lit(False)).alias("failed"))
    if not rows.isStreaming:
        before = Window.partitionBy("key").orderBy("ts", "event").rowsBetween(-limit, -1)
        return named.select("key", "event", (F.coalesce(F.sum(F.col("failed").cast("int")).over(before), F.lit(0)) == limit).alias("open"))

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (run,) = state.get if state.exists else (0,)
        frame, open_ = pd.concat(list(frames)).sort_values(["ts", "event"]), []
        for bad in frame["failed"]:
            open_.append(run >= limit)
            run = run + 1 if bad else 0
        state.update((run,))
        yield pd.DataFrame({"key": keys[0], "event": frame["event"].to_numpy(), "open": open_})

    return named.groupBy("key").applyInPandasWithState(step, "key long, event long, open boolean", "run long", "append", GroupStateTimeout.NoTimeout)


def with_fresh_table(rows: DataFrame, read: Callable[[], DataFrame], on: list[str], write: Callable[[DataFrame, int], None], checkpoint: str):
    """Joins each micro-batch with what ``read`` gives at that time, so a table that changes is seen changed; resumes from ``checkpoint``."""
    merge = lambda batch, n: write(batch.join(read(), on, "left"), n)
    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def compressed(rows: DataFrame, key: str, order: str, text: str, limit: int) -> DataFrame:
    """(key, kept, dropped): of each conversation the last turns that fit ``limit`` characters, and how many go before them."""
    size = F.coalesce(F.length(text), F.lit(0))
    after = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select(key, (F.sum(size).over(after) <= limit).alias("fits"))
    return run.groupBy(key).agg(F.count(F.when(F.col("fits"), 1)).alias("kept"), F.count(F.when(~F.col("fits"), 1)).alias("dropped"))


def merged_state(rows: DataFrame, key: str, order: str, appended: str, reset: str, members: str, count: str) -> DataFrame:
    """(key, appended, members, total): appended values since the last reset, the union of sets, and a sum."""
    last = F.max(F.when(F.col(reset), F.col(order)))
    sums = rows.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(members)))).alias("members"), F.sum(count).alias("total"), last.alias("_reset"))
    kept = rows.join(sums.select(key, "_reset"), key).where(F.col("_reset").isNull() | (F.col(order) > F.col("_reset")))
    lists = kept.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, appended))).alias("a"))
    return sums.join(lists, key, "left").select(key, F.coalesce(F.col(f"a.{appended}"), F.array().cast("array<string>")).alias("appended"), "members", "total")
