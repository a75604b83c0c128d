"""Drift: snapshots of manifests against each other, configurations against a baseline, version histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.functions.expressions import canonical_json
from auditgrove.operators.items import display_url

FIELDS = ("description", "input_schema")
#: What makes a server changed; the list of changes (D2) names the fields above.
COMPARED = (*FIELDS, "output_schema", "parameters", "deprecated")
JSON_FIELDS = ("input_schema", "output_schema", "parameters")


def comparable(df: DataFrame, fields) -> DataFrame:
    """Name and fields, JSON in canonical form (text that is no JSON as it is); a field that a table lacks is null."""

    def value(f: str) -> Column:
        own = F.col(f).cast("string") if f in df.columns else F.lit(None).cast("string")
        return F.coalesce(canonical_json(own), own) if f in JSON_FIELDS else own

    return df.select("server", "name", *[value(f).alias(f) for f in fields])


def paired(old: DataFrame, new: DataFrame, fields) -> DataFrame:
    """Full outer join of two snapshots; ``o`` and ``n`` hold the sides, null if absent.

    Of items that share a name in one snapshot the one with the smallest fields stands for the name, so a snapshot never differs from itself."""
    side = lambda df, c: comparable(df, fields).groupBy("server", "name").agg(F.min(F.struct(*fields)).alias(c))
    before, after = side(old, "o"), side(new, "n").select(F.col("server").alias("server_"), F.col("name").alias("name_"), "n")
    same = F.col("server").eqNullSafe(F.col("server_")) & F.col("name").eqNullSafe(F.col("name_"))
    return before.join(after, same, "full_outer").select(F.coalesce("server", "server_").alias("server"), F.coalesce("name", "name_").alias("name"), "o", "n")


def snapshot_changed(old: DataFrame, new: DataFrame, fields=COMPARED) -> DataFrame:
    """Per server, whether anything was added, removed or modified."""
    differs = F.col("o").isNull() | F.col("n").isNull()
    for f in fields:
        differs = differs | ~F.col(f"o.{f}").eqNullSafe(F.col(f"n.{f}"))
    return paired(old, new, fields).groupBy("server").agg(F.bool_or(differs).alias("changed"))


def snapshot_changes(old: DataFrame, new: DataFrame, fields=FIELDS) -> DataFrame:
    """A row per added or removed item and per changed field."""
    none = F.lit(None).cast("string")
    row = lambda kind, field, a, b, diff: F.struct(F.lit(kind).alias("change_type"), field.alias("field"), a.alias("old_value"), b.alias("new_value"), diff.alias("diff"))
    added = F.when(F.col("o").isNull(), row("added", none, none, none, none))
    removed = F.when(F.col("n").isNull(), row("removed", none, none, none, none))
    both = F.col("o").isNotNull() & F.col("n").isNotNull()
    changed = []
    for f in fields:
        a, b = F.col(f"o.{f}"), F.col(f"n.{f}")
        label = F.when(a.isNull(), f"{f} added").when(b.isNull(), f"{f} removed").otherwise(f"{f} changed")
        changed.append(F.when(both & ~a.eqNullSafe(b), row("modified", F.lit(f), a, b, label)))
    rows = paired(old, new, fields).select("server", "name", F.explode(F.array_compact(F.array(added, removed, *changed))).alias("c"))
    return rows.select("server", "name", "c.*")


def change_rollup(changes: DataFrame) -> DataFrame:
    """D3: totals per server and the kinds of change in order."""
    n = lambda k: F.count(F.when(F.col("change_type") == k, 1))
    out = changes.groupBy("server").agg(n("added").alias("added"), n("removed").alias("removed"), n("modified").alias("modified"))
    kinds = F.array_compact(F.array(*[F.when(F.col(k) > 0, k) for k in ("added", "removed", "modified")]))
    return out.withColumn("total", F.col("added") + F.col("removed") + F.col("modified")).withColumn("change_types", kinds)


def fingerprint() -> Column:
    """Digest of a server definition; equal definitions agree, fields cannot run into each other."""
    env = F.array_sort(F.map_entries("env"))
    return F.sha2(F.to_json(F.struct("name", "url", "command", "args", env.alias("env")), {"ignoreNullFields": "false"}), 256)


def config_drift(configs: DataFrame, baseline: DataFrame, key: str = "dedup_key", report_removed: bool = False) -> DataFrame:
    """Definitions whose fingerprint differs from the baseline's; with ``report_removed`` also keys that are gone."""
    now = configs.select(F.col(key).alias("dedup_key"), F.coalesce("name", display_url()).alias("target_name"), fingerprint().alias("fingerprint"))
    base = baseline.select("dedup_key", F.col("fingerprint").alias("baseline"))
    found = now.join(base, "dedup_key").where("fingerprint <> baseline").select("dedup_key", "target_name", F.lit("MCPConfigChanged").alias("rule_name"))
    if report_removed:
        gone = base.join(now, "dedup_key", "left_anti").select("dedup_key", F.lit(None).cast("string").alias("target_name"), F.lit("MCPConfigRemoved").alias("rule_name"))
        found = found.unionByName(gone)
    return found.withColumn("severity", F.lit("HIGH")).withColumn("category", F.lit("supply-chain")).withColumn("confidence", F.lit("MEDIUM"))


def baseline_upsert(configs: DataFrame, baseline: DataFrame) -> DataFrame:
    """The baseline with unseen keys added and known ones untouched; of equal new keys the smallest fingerprint is stored."""
    fresh = configs.select("dedup_key", fingerprint().alias("fingerprint")).groupBy("dedup_key").agg(F.min("fingerprint").alias("fingerprint"))
    known = baseline.select("dedup_key", "fingerprint")
    return known.unionByName(fresh.join(known, "dedup_key", "left_anti"))


def version_history(snapshots: DataFrame) -> DataFrame:
    """Per URL the number of snapshots and versions, the latest hash, and when it was last seen; a version starts where the hash changes."""
    order = Window.partitionBy("url").orderBy("ts", "version_hash")
    steps = snapshots.withColumn("new_version", ~F.col("version_hash").eqNullSafe(F.lag("version_hash").over(order)) | (F.row_number().over(order) == 1))
    return steps.groupBy("url").agg(F.count("*").alias("n_snapshots"), F.count_if("new_version").alias("total_versions"), F.max_by("version_hash", F.struct("ts", "version_hash")).alias("latest_hash"), F.max("ts").alias("last_updated"))
