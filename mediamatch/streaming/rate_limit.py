"""Per-client rate limit with anchored windows.

A window opens at a client's first request, lasts a fixed time and is never extended; its first `cap`
requests pass. Windows follow each client's own traffic, so they are not the epoch-aligned windows of
`F.window`. The clock runs in whole seconds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediamatch.schema import RATE_WINDOW_SECONDS, Settings


def _second(ts: Column) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(1_000_000)).cast("bigint")


def _count_before(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per (client, second), requests of the same window in earlier seconds. Rows come sorted; only the open window is kept."""
    client, opened, used = None, 0, 0
    for batch in batches:
        before = np.empty(len(batch), dtype=np.int64)
        for i, (who, second, n) in enumerate(zip(batch["client"], batch["second"], batch["n"])):
            if who != client or second >= opened + RATE_WINDOW_SECONDS:
                client, opened, used = who, second, 0
            before[i] = used
            used += n
        yield batch.assign(before=before)[["client", "second", "before"]]


def limit_requests(requests: DataFrame, cap: int = Settings().rate_limit, tie: str = "event_id") -> DataFrame:
    """Add `allowed` to requests (client, ts, tie column).

    Requests are counted per client and second before anything is shuffled, so the sequential pass
    over a client reads one row per second of its traffic however busy it is. In a second that is
    only partly allowed, the cut is the last allowed (ts, tie), found by a group-limited window.
    """
    timed = requests.withColumn("second", _second(F.col("ts")))
    per_second = timed.groupBy("client", "second").agg(F.count("*").alias("n"))
    windows = (
        per_second.repartition("client")
        .sortWithinPartitions("client", "second")
        .mapInPandas(_count_before, "client string, second long, before long")
    )
    order = Window.partitionBy("client", "second").orderBy("ts", tie)
    first = timed.withColumn("n", F.row_number().over(order)).where(F.col("n") <= cap).select("client", "second", "ts", tie, "n")
    cut = (
        first.join(windows.where(F.col("before") < cap), ["client", "second"])
        .where(F.col("before") + F.col("n") <= cap)
        .groupBy("client", "second")
        .agg(F.max(F.struct("ts", tie)).alias("cut"))
    )
    return (
        timed.join(cut, ["client", "second"], "left")
        .withColumn("allowed", F.coalesce(F.struct("ts", tie) <= F.col("cut"), F.lit(False)))
        .drop("second", "cut")
    )


class _Limiter(StatefulProcessor):
    """State per client: when its window opened and how many requests it has seen.

    An event-time timer at the end of the window drops the state, as the next request opens a new one anyway.
    """

    def __init__(self, cap: int, tie: str, timed: bool):
        self.cap, self.tie, self.timed = cap, tie, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "opened long, used long")

    def _verdicts(self, client, rows: list[tuple], allowed: list[bool], late: bool = False) -> pd.DataFrame:
        ts = pd.Series([pd.Timestamp(r[0], unit="us") for r in rows], dtype="datetime64[us]")
        return pd.DataFrame({"client": client, self.tie: [r[1] for r in rows], "ts": ts, "allowed": allowed, "late": late})

    def handleInputRows(self, key, rows, timerValues):
        opened, used = self.window.get() if self.window.exists() else (None, 0)
        closed = timerValues.getCurrentWatermarkInMs() * 1000 if self.timed else None
        # Of each second only the count and the `cap` earliest requests are kept; a later one is refused at once.
        counts: dict[int, int] = {}
        first: dict[int, list[tuple]] = {}
        for chunk in rows:
            refused: list[tuple] = []
            late: list[tuple] = []
            micros = chunk["at"].astype("int64")
            for at, tie in zip(micros.tolist(), chunk[self.tie].tolist()):
                second = at // 1_000_000
                if closed is not None and (at < closed or (opened is not None and second < opened)):
                    late.append((at, tie))
                    continue
                counts[second] = counts.get(second, 0) + 1
                kept = first.setdefault(second, [])
                # Negated pairs make the heap give up the latest request.
                if len(kept) < self.cap:
                    heapq.heappush(kept, (-at, -tie))
                else:
                    at, tie = heapq.heappushpop(kept, (-at, -tie))
                    refused.append((-at, -tie))
            if refused:
                yield self._verdicts(key[0], refused, [False] * len(refused))
            if late:
                yield self._verdicts(key[0], late, [False] * len(late), True)
        if not counts:
            return
        judged: list[tuple] = []
        allowed: list[bool] = []
        before = opened
        for second in sorted(counts):
            if opened is None or second >= opened + RATE_WINDOW_SECONDS:
                opened, used = second, 0
            kept = sorted((-at, -tie) for at, tie in first[second])
            judged += kept
            allowed += [used + i <= self.cap for i in range(1, len(kept) + 1)]
            used += counts[second]
        self.window.update((int(opened), int(used)))
        if self.timed and opened != before:
            if before is not None:
                self.handle.deleteTimer((before + RATE_WINDOW_SECONDS) * 1000)
            self.handle.registerTimer(int((opened + RATE_WINDOW_SECONDS) * 1000))
        yield self._verdicts(key[0], judged, allowed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


def limit_stream(
    requests: DataFrame, cap: int = Settings().rate_limit, tie: str = "event_id", lateness: str | None = None
) -> DataFrame:
    """Streaming form of `limit_requests`: (client, tie, ts, allowed, late).

    State is kept per client between micro-batches. With `lateness`, an interval such as "10 minutes", the watermark
    follows that far behind the latest request, and a client's state goes once the watermark has passed the end of its
    window. A request from before the watermark or from before the client's open window is not counted: it comes back
    refused and marked as late. Without `lateness` state never goes, and a request that is older than the open
    window counts in it. Needs the RocksDB state store.
    """
    timed = requests.select("client", tie, F.col("ts").cast("timestamp").alias("ts"))
    if lateness is not None:
        timed = timed.withWatermark("ts", lateness)
    # Plain numbers bear no watermark, so that late requests reach the processor instead of being dropped.
    return (
        timed.select("client", tie, F.unix_micros("ts").alias("at"))
        .groupBy("client")
        .transformWithStateInPandas(
            statefulProcessor=_Limiter(cap, tie, lateness is not None),
            outputStructType=f"client string, {tie} long, ts timestamp, allowed boolean, late boolean",
            outputMode="Append",
            timeMode="EventTime" if lateness is not None else "None",
        )
    )
