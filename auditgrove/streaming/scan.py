"""Streams of items and configurations: rule findings, windowed severities, drift."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditgrove.operators.drift import fingerprint
from auditgrove.operators.catalog import BUILT_IN, Catalog, rules_of
from auditgrove.operators.rules import HAYSTACKS, annotate_findings, bound, matched_rules
from auditgrove.streaming.state import micros, stateful


def stream_scan(items: DataFrame, phase: str = "pre", haystack: str = "full", catalog: Catalog = BUILT_IN) -> DataFrame:
    """Findings of a stream of items that carry an event time ``ts``; stateless, works on a batch alike."""
    source = bound(items, HAYSTACKS[haystack], "ts", "server", "item_type", "item_id", "name", catalog=catalog, phase=phase)
    out = source.select("ts", "server", F.col("item_type").alias("target_type"), "item_id", F.col("name").alias("target_name"), F.explode(matched_rules(rules_of(phase, catalog), catalog)).alias("rule_name"))
    return annotate_findings(out, catalog)


def severity_windows(findings: DataFrame, length: str = "1 hour", slide: str | None = None, gap: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Findings per severity and server in tumbling, sliding (``slide``) or session (``gap``) windows; later rows than the watermark are dropped."""
    window = F.session_window("ts", gap) if gap else F.window("ts", length, slide)
    counted = findings.withWatermark("ts", watermark).groupBy(window.alias("w"), "server", "severity").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "server", "severity", "n")


class DriftWatch(StatefulProcessor):
    """The baseline of each key. Definitions of a key without one wait in a list until its earliest is known, so that no batch of a key is held in memory."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.base = handle.getValueState("base", "fingerprint string")
        self.waiting = handle.getListState("waiting", "us long, fingerprint string")
        self.last = handle.getValueState("last", "ms long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.base.update((initialState["fingerprint"].iloc[0],))

    def changed(self, key, us: list[int], prints: list[str], base: str) -> pd.DataFrame:
        kept = [(u, f) for u, f in zip(us, prints) if f != base]
        return pd.DataFrame({"dedup_key": [key[0]] * len(kept), "ts": pd.to_datetime([u for u, _ in kept], unit="us"), "fingerprint": [f for _, f in kept], "baseline": [base] * len(kept)})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = self.base.get()[0] if self.base.exists() else None
        first, last = None, 0
        for part in rows:
            us, prints = micros(part["ts"]), part["fingerprint"].tolist()
            last = max(last, max(us))
            if base is None:
                first = min([*zip(us, prints)] + ([first] if first else []))
                self.waiting.appendList(list(zip(us, prints)))
            else:
                yield self.changed(key, us, prints, base)
        if base is None:
            self.base.update((first[1],))
            for us, f in self.waiting.get():
                if f != first[1]:
                    yield self.changed(key, [us], [f], first[1])
            self.waiting.clear()
        if self.idle_ms is not None:
            ends = max(last // 1000 + self.idle_ms, timerValues.getCurrentWatermarkInMs()) + 1
            self.last.update((ends,))
            self.handle.registerTimer(ends)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.last.exists() and self.last.get()[0] <= expiredTimerInfo.getExpiryTimeInMs():
            self.base.clear()
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def stream_drift(configs: DataFrame, idle_seconds: int | None = None, watermark: str = "1 hour", baseline: DataFrame | None = None) -> DataFrame:
    """T4: the first fingerprint of a key is its baseline; each later definition that differs from it emits a change.

    A stored ``baseline`` (dedup_key, fingerprint; a row per key) is the state that the stream starts from, so a first definition that differs from it is a change already.
    It is read when the stream first starts; a restart from a checkpoint goes on with the checkpoint's state.

    The baseline stays, as in the batch form, so a changed definition is reported until it is back. With ``idle_seconds`` a key
    that is silent for so long behind the watermark is forgotten, which bounds the state; its next definition is a new baseline.
    """
    rows = configs.select("dedup_key", "ts", fingerprint().alias("fingerprint"))
    if idle_seconds is not None:
        rows = rows.withWatermark("ts", watermark)
    known = None if baseline is None else baseline.select("dedup_key", "fingerprint")
    mode = "None" if idle_seconds is None else "EventTime"
    return stateful(rows, "dedup_key", DriftWatch(None if idle_seconds is None else idle_seconds * 1000), "dedup_key string, ts timestamp, fingerprint string, baseline string", mode, known)


def batch_drift(configs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """T4 over a finished table: what the stream emits for the same rows. Keys of a stored ``baseline`` are compared with it, others with their first definition."""
    rows = configs.select("dedup_key", "ts", fingerprint().alias("fingerprint"))
    base = rows.groupBy("dedup_key").agg(F.min_by("fingerprint", F.struct("ts", "fingerprint")).alias("baseline"))
    if baseline is not None:
        known = baseline.select("dedup_key", F.col("fingerprint").alias("stored"))
        base = base.join(known, "dedup_key", "left").select("dedup_key", F.coalesce("stored", "baseline").alias("baseline"))
    return rows.join(base, "dedup_key").where("fingerprint <> baseline")
