"""Time-based state per key: sliding-log rate limit and expiring cache, as batch folds and as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def sorted_events(df: DataFrame, key: str):
    """Rows dealt by key, in order of time within it; a task streams them and holds the state of one key."""
    return df.repartition(key).sortWithinPartitions(key, "ts", "event_id")


def admit(log: list[int], now: int, limit: int, window: int) -> bool:
    """Keep the times within the window; admit and log unless the limit is reached. Rejected requests are not logged."""
    log[:] = [t for t in log if now - t < window]
    if len(log) >= limit:
        return False
    log.append(now)
    return True


def rate_limit(requests: DataFrame, limit: int = 10, window_seconds: int = 60, key: str = "url") -> DataFrame:
    """Requests (key, ts, event_id) with ``allowed``. State is at most ``limit`` times, whatever a key's share of the rows."""
    fields = f"{key} string, event_id long, ts timestamp, allowed boolean"
    rows = requests.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, log = object(), []
        for part in parts:
            allowed = []
            for k, us in zip(part[key], part["us"]):
                if k != now:
                    now, log = k, []
                allowed.append(admit(log, us, limit, window_seconds * 1_000_000))
            yield part.drop(columns="us").assign(allowed=allowed)

    return sorted_events(rows, key).mapInPandas(run, fields)


def cached(entry: list, now: int, ttl: int) -> bool:
    """Hit while now <= stored + ttl; a miss stores."""
    if entry and now <= entry[0] + ttl:
        return True
    entry[:] = [now]
    return False


def ttl_cache(lookups: DataFrame, ttl_seconds: int = 3600, key: str = "url") -> DataFrame:
    """Lookups (key, ts, event_id) with ``hit`` and ``cached_at``, the time of the entry afterwards; where lookups say how many ``tools`` a miss
    stores, also the entry's ``tools``."""
    counted = "tools" in lookups.columns
    fields = f"{key} string, event_id long, ts timestamp, " + "tools long, " * counted + "hit boolean, cached_us long"
    tools = [F.coalesce(F.col("tools").cast("long"), F.lit(0).cast("long")).alias("tools")] if counted else []
    rows = lookups.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), *tools)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, entry, held = object(), [], 0
        for part in parts:
            hits, at, many = [], [], []
            for k, us, offered in zip(part[key], part["us"], part["tools"] if counted else part["us"]):
                if k != now:
                    now, entry = k, []
                hits.append(cached(entry, us, ttl_seconds * 1_000_000))
                held = held if hits[-1] else offered
                at.append(entry[0])
                many.append(held)
            yield part.drop(columns="us").assign(hit=hits, cached_us=at, **({"tools": many} if counted else {}))

    out = sorted_events(rows, key).mapInPandas(run, fields)
    return out.withColumn("cached_at", F.timestamp_micros("cached_us")).drop("cached_us")


def cache_stats(results: DataFrame, at, ttl_seconds: int = 3600, key: str = "url") -> DataFrame:
    """Entries in all, active and expired at a time, and the tools that they hold (0 for results without ``tools``).

    A key's entry is its latest; of several results with the latest time the one with most tools counts."""
    tools = F.coalesce(F.col("tools").cast("long"), F.lit(0)) if "tools" in results.columns else F.lit(0).cast("long")
    last = results.groupBy(key).agg(F.max(F.struct("cached_at", tools.alias("tools"))).alias("e")).select("e.*")
    alive = F.unix_micros(F.lit(at).cast("timestamp")) <= F.unix_micros("cached_at") + ttl_seconds * 1_000_000
    return last.agg(F.count("*").alias("total"), F.count_if(alive).alias("active"), F.count_if(~alive).alias("expired"), F.coalesce(F.sum("tools"), F.lit(0).cast("long")).alias("tools"))


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful(rows: DataFrame, key: str, processor: StatefulProcessor, fields: str, mode: str, initial: DataFrame | None = None) -> DataFrame:
    """A stream through a processor with state per key. States of this kind need the store on disk, which the session is set to."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return rows.groupBy(key).transformWithStateInPandas(processor, fields, "append", mode, initial.groupBy(key) if initial is not None else None)


def micros(times: pd.Series) -> list[int]:
    return times.astype("datetime64[us]").astype("int64").tolist()


class RateLimiter(StatefulProcessor):
    """Requests wait in a map of ``step`` long spans of event time; when the watermark passes the end of a span its timer settles them in order.

    The log of admitted times is a list of at most ``limit``; it goes when a window has passed since the last of them.
    """

    def __init__(self, key: str, limit: int, window: int, step: int):
        self.key, self.limit, self.window, self.step = key, limit, window, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "until long", "times array<long>, events array<long>")
        self.log = handle.getListState("log", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            us = pd.Series(micros(part["ts"]))
            for until, own in part.assign(us=us.to_numpy()).groupby((us // self.step + 1).to_numpy() * self.step):
                held = self.waiting.getValue((int(until),)) or ([], [])
                self.waiting.updateValue((int(until),), ([*held[0], *own["us"].tolist()], [*held[1], *own["event_id"].tolist()]))
                self.handle.registerTimer(int(until) // 1000)
        yield pd.DataFrame({self.key: pd.Series([], dtype=str), "event_id": pd.Series([], dtype="int64"), "ts": pd.Series([], dtype="datetime64[us]"), "allowed": pd.Series([], dtype=bool)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        held, log = self.waiting.getValue((until,)), [us for (us,) in self.log.get()]
        if held is not None:
            self.waiting.removeKey((until,))
            due = sorted(zip(*held))
            allowed = [admit(log, us, self.limit, self.window) for us, _ in due]
            self.log.put([(us,) for us in log])
            # the log ends with the span in which its last time leaves the window
            self.handle.registerTimer(((log[-1] + self.window) // self.step + 1) * self.step // 1000)
            yield pd.DataFrame({self.key: [key[0]] * len(due), "event_id": [e for _, e in due], "ts": pd.to_datetime([us for us, _ in due], unit="us"), "allowed": allowed})
        elif log and log[-1] + self.window < until:
            self.log.clear()

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, limit: int = 10, window_seconds: int = 60, key: str = "url", watermark: str = "1 hour", step_seconds: int = 1) -> DataFrame:
    """T1 on a stream. Requests are settled in order of event time, so the rows are those of the batch form however they arrive within the watermark; later ones are
    dropped. A request leaves when the watermark has passed its span of ``step_seconds``. A task holds one span of one key."""
    rows = requests.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", watermark)
    return stateful(rows, key, RateLimiter(key, limit, window_seconds * 1_000_000, step_seconds * 1_000_000), f"{key} string, event_id long, ts timestamp, allowed boolean", "EventTime")


class ExpiringCache(StatefulProcessor):
    """One entry per key: when it was stored and how many tools it holds. The store drops it by itself ``keep_ms`` after it was written."""

    def __init__(self, key: str, ttl: int, keep_ms: int):
        self.key, self.ttl, self.keep_ms = key, ttl, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entry = handle.getValueState("entry", "us long, tools long", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.entry.get() if self.entry.exists() else None
        before, now, tools = held, [held[0]] if held else [], held[1] if held else 0
        for part in rows:
            part = part.sort_values(["ts", "event_id"])
            hits, at, many = [], [], []
            for us, offered in zip(micros(part["ts"]), part["tools"].tolist()):
                hits.append(cached(now, us, self.ttl))
                tools = tools if hits[-1] else int(offered)
                at.append(now[0])
                many.append(tools)
            yield pd.DataFrame({self.key: [key[0]] * len(part), "event_id": part["event_id"].tolist(), "ts": part["ts"].tolist(), "hit": hits, "cached_at": pd.to_datetime(at, unit="us"), "tools": many})
        if now and (now[0], tools) != before:
            self.entry.update((now[0], tools))

    def close(self) -> None:
        pass


def stream_ttl_cache(lookups: DataFrame, ttl_seconds: int = 3600, key: str = "url", keep_seconds: int | None = None) -> DataFrame:
    """T2 on a stream: ``hit``, and ``cached_at`` and ``tools`` of the entry afterwards. Lookups are answered as they arrive, a batch's rows of a key part by part, each in order of time.

    Whether an entry is alive is told by event time, as in the batch form; the state store forgets it ``keep_seconds`` (``ttl_seconds`` if not given) of clock time after it was
    stored, so the state empties by itself. A stream that is replayed slower than it happened needs longer ``keep_seconds``.
    ``tools`` of a lookup is what a miss stores; absent or null it is 0."""
    tools = F.coalesce(F.col("tools").cast("long"), F.lit(0).cast("long")) if "tools" in lookups.columns else F.lit(0).cast("long")
    rows = lookups.select(F.col(key).cast("string").alias(key), F.col("event_id").cast("long"), F.col("ts").cast("timestamp").alias("ts"), tools.alias("tools"))
    keep = 1000 * (ttl_seconds if keep_seconds is None else keep_seconds)
    return stateful(rows, key, ExpiringCache(key, ttl_seconds * 1_000_000, keep), f"{key} string, event_id long, ts timestamp, hit boolean, cached_at timestamp, tools long", "ProcessingTime")
