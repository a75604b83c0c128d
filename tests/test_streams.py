"""Streams replayed in batches give what the batch forms give."""

import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from auditgrove.operators.configs import dedup_key
from auditgrove.operators.drift import config_drift
from auditgrove.sources.baselines import BaselineStore, VersionTaken
from auditgrove.streaming import scan, state

EVENTS = [(k, i, i * 1500 % 9000 + i) for i in range(60) for k in ("a", "b")]


@pytest.fixture
def events(spark):
    rows = spark.createDataFrame([(k, n, s) for n, (k, _, s) in enumerate(EVENTS)], "url string, event_id long, s long")
    return rows.select("url", "event_id", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))


def replay(spark, df, operator, tmp_path, name, order="ts", parts=3, mode="append", clocked=False):
    """Feed df to a stream in order of time, file by file, and collect the output. A stream whose state follows the clock (``clocked``) never ends of itself."""
    source = str(tmp_path / f"{name}-in")
    bounds = [r[0] for r in df.select(F.ntile(parts).over(Window.orderBy(order)).alias("n")).distinct().collect()]
    cut = df.withColumn("n", F.ntile(parts).over(Window.orderBy(order))).cache()
    for n in sorted(bounds):
        cut.where(F.col("n") == n).drop("n").coalesce(1).write.mode("append").parquet(source)
        time.sleep(1.1)  # files are read in order of their time, which has seconds
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
    writer = operator(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-state"))
    if clocked:
        query = writer.trigger(processingTime="2 seconds").start()
        ends = time.time() + 60
        while time.time() < ends and sum(p["numInputRows"] for p in query.recentProgress) < df.count():
            time.sleep(0.5)
        query.stop()
    else:
        assert writer.trigger(availableNow=True).start().awaitTermination(120)
    return spark.table(name)


def test_rate_limit(events, spark, tmp_path):
    batch = state.rate_limit(events, 3, 600)
    key = lambda df: sorted((r["event_id"], r["allowed"]) for r in df.collect())
    log, expected = {}, []
    for r in sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"])):
        own = [t for t in log.get(r["url"], []) if (r["ts"] - t).total_seconds() < 600]
        expected.append((r["event_id"], len(own) < 3))
        log[r["url"]] = own + [r["ts"]] if len(own) < 3 else own
    assert key(batch) == sorted(expected)
    # the span of the last request is settled when the watermark has passed it: a later request of another key moves it on
    later = events.unionByName(spark.createDataFrame([("z", -1)], "url string, event_id long").withColumn("ts", F.timestamp_seconds(F.lit(2_000_000))))
    streamed = replay(spark, later, lambda s: state.stream_rate_limit(s, 3, 600, watermark="0 seconds"), tmp_path, "limited")
    assert key(streamed) == sorted(expected)


def test_rate_limit_of_one_key_in_any_order(spark, tmp_path):
    """All rows have one key and arrive in one batch, out of order; several share a microsecond."""
    rows = [("k", n, 1_000_000 + (n * 7919) % 500 // 2) for n in range(500)] + [("z", -1, 2_000_000)]
    df = spark.createDataFrame(rows, "url string, event_id long, s long").select("url", "event_id", F.timestamp_seconds("s").alias("ts")).repartition(3)
    key = lambda d: sorted((r["event_id"], r["allowed"]) for r in d.where("event_id >= 0").collect())
    streamed = replay(spark, df, lambda s: state.stream_rate_limit(s, 5, 60, watermark="0 seconds"), tmp_path, "one_key", parts=1)
    assert key(streamed) == key(state.rate_limit(df, 5, 60))


def test_ttl_cache(events, spark, tmp_path):
    lookups = events.withColumn("tools", F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 5))
    batch = state.ttl_cache(lookups, 900)
    key = lambda df: sorted((r["event_id"], r["hit"], r["cached_at"], r["tools"]) for r in df.collect())
    streamed = replay(spark, lookups, lambda s: state.stream_ttl_cache(s, 900), tmp_path, "cached", clocked=True)
    assert key(streamed) == key(batch)
    held, expected = {}, []
    for r in sorted(lookups.collect(), key=lambda r: (r["ts"], r["event_id"])):
        at, tools = held.get(r["url"], (None, 0))
        hit = at is not None and (r["ts"] - at).total_seconds() <= 900
        held[r["url"]] = (at, tools) if hit else (r["ts"], r["tools"] or 0)
        expected.append((r["event_id"], hit, *held[r["url"]]))
    assert key(batch) == sorted(expected)
    stats = state.cache_stats(batch, "1970-01-12 13:46:40", 900).first()
    assert (stats["total"], stats["active"], stats["expired"], stats["tools"]) == (2, 2, 0, sum(t for _, t in held.values()))
    assert [r["hit"] for r in state.ttl_cache(events, 900).orderBy("event_id").collect()] == [h for _, h, _, _ in sorted(expected)]  # without tools


def test_cache_state_empties_by_itself(events, spark, tmp_path):
    """The store keeps an entry for a second of clock time and batches start two seconds apart, so a later file meets an empty state."""
    one = events.where("url = 'a'")
    streamed = replay(spark, one, lambda s: state.stream_ttl_cache(s, 10**6, keep_seconds=1), tmp_path, "emptied", clocked=True)
    assert streamed.where("not hit").count() > 1  # the entry was gone again
    assert replay(spark, one, lambda s: state.stream_ttl_cache(s, 10**6), tmp_path, "kept", clocked=True).where("not hit").count() == 1


def test_scan_and_windows(spark, tmp_path):
    rows = [(i, "s", "tool", f"t{i}", "n", "x; rm -rf /" if i % 2 else "plain") for i in range(20)]
    items = spark.createDataFrame(rows, "m long, server string, item_type string, item_id string, name string, full_text string").withColumn("ts", F.timestamp_seconds(F.col("m") * 600)).drop("m")
    key = lambda df: sorted((r["item_id"], r["rule_name"]) for r in df.collect())
    assert key(replay(spark, items, scan.stream_scan, tmp_path, "scanned")) == key(scan.stream_scan(items))
    counts = lambda df: sorted((r["window_start"], r["n"]) for r in df.collect())
    streamed = replay(spark, items, lambda s: scan.severity_windows(scan.stream_scan(s)), tmp_path, "windows", mode="complete")
    assert counts(streamed) == counts(scan.severity_windows(scan.stream_scan(items)))
    assert scan.severity_windows(scan.stream_scan(items), slide="30 minutes").count() > scan.severity_windows(scan.stream_scan(items)).count()
    assert scan.severity_windows(scan.stream_scan(items), gap="30 minutes").count() == 1


def test_drift(spark, tmp_path):
    rows = [(f"http://u{i % 3}", "abc"[i % 2 if i < 12 else 2], i) for i in range(20)]
    configs = spark.createDataFrame(rows, "url string, name string, s long").select("url", "name", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.lit(None).cast("map<string,string>").alias("env"))
    key = lambda df: sorted((r["dedup_key"], r["ts"]) for r in df.collect())
    assert key(replay(spark, dedup_key(configs), scan.stream_drift, tmp_path, "drifted")) == key(scan.batch_drift(dedup_key(configs)))


def test_drift_from_a_stored_baseline(spark, tmp_path):
    rows = [(f"http://u{i % 3}", "abc"[i % 2 if i < 12 else 2], i) for i in range(20)]
    configs = spark.createDataFrame(rows, "url string, name string, s long").select("url", "name", F.timestamp_seconds("s").alias("ts"), F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.lit(None).cast("map<string,string>").alias("env"))
    keyed = dedup_key(configs)
    store = BaselineStore(spark, str(tmp_path / "store"))
    store.upsert(keyed.where("url <> 'http://u2' and name = 'b'"))
    key = lambda df: sorted((r["dedup_key"], r["ts"], r["baseline"]) for r in df.collect())
    streamed = replay(spark, keyed, lambda s: scan.stream_drift(s, baseline=store.read()), tmp_path, "from_store")
    assert key(streamed) == key(scan.batch_drift(keyed, store.read()))
    assert key(streamed) != key(scan.batch_drift(keyed))
    last = keyed.orderBy(F.desc("ts")).limit(3)
    drifted = {r["dedup_key"] for r in config_drift(last, store.read()).collect()}
    assert drifted == {k for k, _, _ in key(scan.batch_drift(last, store.read()))}


def test_baseline_versions(spark, tmp_path):
    store = BaselineStore(spark, str(tmp_path / "store"))
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "dedup_key string, fingerprint string")
    held = lambda: sorted(map(tuple, store.read().collect()))
    assert store.version() == 0 and held() == []
    assert store.publish(rows(("a", "1")), 0) == 1
    # a writer that dies before it names its version leaves the one before readable
    rows(("x", "9")).write.parquet(f"{store.path}/data-2-dead")
    assert (store.version(), held()) == (1, [("a", "1")])
    # of two writers that start from one version, the second is told so
    assert store.publish(rows(("a", "1"), ("b", "2")), 1) == 2
    with pytest.raises(VersionTaken):
        store.publish(rows(("c", "3")), 1)
    assert held() == [("a", "1"), ("b", "2")]
    # an entry that is not written to its end is none
    (tmp_path / "store" / "versions").joinpath(f"{3:020d}").write_text("data-3")
    assert (store.version(), held()) == (2, [("a", "1"), ("b", "2")])
    with pytest.raises(VersionTaken):
        store.publish(rows(("a", "1")), 2)
    store.vacuum()
    assert store.publish(rows(("a", "1")), 2) == 3
    store.vacuum(keep=1)
    assert (store.version(), held()) == (3, [("a", "1")]) and len([f for f in (tmp_path / "store").iterdir() if f.name.startswith("data-")]) == 1
