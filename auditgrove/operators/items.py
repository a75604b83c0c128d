"""Items (tools, prompts, resources) as one table, and filters on findings, configurations and scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrove.functions.expressions import pick, severity_rank

ITEM_COLUMNS = ["server", "item_type", "item_id", "name", "uri", "description", "input_schema", "output_schema", "parameters", "metadata", "raw_json", "category", "tags"]
PLURALS = {"tool": "tools", "prompt": "prompts", "resource": "resources"}

#: Check toggle -> the finding types it governs.
CHECKS = {
    "tool_poisoning": ["ToolPoisoning"], "sql_injection": ["SQLInjection"], "command_injection": ["CommandInjection"],
    "path_traversal": ["PathTraversal", "PathTraversalVulnerability"], "auth_bypass": ["AuthBypass"], "prompt_injection": ["PromptInjection"],
    "jailbreak": ["Jailbreak"], "pii_leakage": ["PIILeakage"],
    "secrets_leakage": ["SecretsLeakage", "SSHKeyExposure", "PEMFileAccess", "EnvironmentVariableLeakage"],
}


def to_items(tools: DataFrame | None = None, prompts: DataFrame | None = None, resources: DataFrame | None = None) -> DataFrame:
    """one row per item. ``scan_text`` is ``TYPE: name``; ``full_text`` adds description, URI and schema."""
    parts = [pick(df, ITEM_COLUMNS, {"tags": "array<string>"}).withColumn("item_type", F.lit(kind)) for kind, df in (("tool", tools), ("prompt", prompts), ("resource", resources)) if df is not None]
    items = parts[0]
    for p in parts[1:]:
        items = items.unionByName(p)
    plural = F.create_map(*[F.lit(x) for kv in PLURALS.items() for x in kv])[F.col("item_type")]
    scan = F.concat(F.upper("item_type"), F.lit(": "), F.coalesce("name", F.lit("")))
    return items.withColumn("item_type_plural", plural).withColumn("scan_text", scan).withColumn("full_text", F.concat_ws("\n", scan, "description", "uri", "input_schema"))


def filter_findings(findings: DataFrame, min_severity: str = "LOW", checks: list[str] | None = None, type_column: str = "rule_name") -> DataFrame:
    """findings at or above a severity, and of the enabled checks; types that no check governs stay."""
    out = findings.where(severity_rank(F.col("severity")) <= severity_rank(F.lit(min_severity)))
    if checks is None:
        return out
    off = sorted({t for c, ts in CHECKS.items() if c not in checks for t in ts})
    return out.where(~F.col(type_column).isin(off)) if off else out


def split_summaries(findings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matches on items, findings on server definitions, summary rows)."""
    kind = F.col("target_type")
    return findings.where(~kind.isin("summary", "server")), findings.where(kind == "server"), findings.where(kind == "summary")


def env_values(env: Column) -> Column:
    """values of an environment map that may be real secrets, in key order.

    Kept are trimmed values of at least eight bytes that are neither placeholders nor booleans.
    """
    values = F.transform(F.array_sort(F.map_entries(env)), lambda e: F.trim(e["value"]))

    def real(v: Column) -> Column:
        placeholder = F.startswith(v, F.lit("${")) | F.startswith(v, F.lit("$(")) | F.contains(v, F.lit("{{")) | F.contains(v, F.lit("<"))
        return ~placeholder & ~F.lower(v).isin("true", "false") & (F.octet_length(v) >= 8)

    return F.filter(values, real)


def env_value_filter(configs: DataFrame) -> DataFrame:
    """F4 on a table: one row per server and kept value, with its place."""
    return configs.select("server_id", F.posexplode(env_values(F.col("env"))).alias("place", "value"))


#: (category, text in the error, hint), first match counts; fixed values of the triage.
TRIAGE = [
    ("missing_token", ["GITHUB_PERSONAL_ACCESS_TOKEN not set"], "set the access token in the environment"),
    ("mount_denied", ["mounts denied", "not shared from the host"], "fix the volume mount path"),
    ("missing_file", ["No such file or directory"], "check that the image or file exists"),
    ("closed_at_start", ["connection closed: initialize response"], "server failed to start"),
    ("unauthorized", ["401", "Unauthorized"], "check key, token and permissions"),
]


def triage_failures(scans: DataFrame) -> DataFrame:
    """failed scans with a category and a hint; the trimmed error where nothing fits."""
    error = F.coalesce("status_detail", F.lit(""))
    category, hint = F.lit("other"), F.trim(error)
    for name, needles, text in reversed(TRIAGE):
        hit = F.lit(False)
        for n in needles:
            hit = hit | F.contains(error, F.lit(n))
        hit = hit & ((F.col("status") == "AuthenticationError") if name == "unauthorized" else (F.col("status") == "Failed"))
        category, hint = F.when(hit, name).otherwise(category), F.when(hit, text).otherwise(hint)
    timeout = F.col("status") == "Timeout"
    return scans.where("status <> 'Success'").withColumn("category", F.when(timeout, "timeout").otherwise(category)).withColumn("hint", F.when(timeout, "increase the timeout").otherwise(hint))


def display_url(c=F.col) -> Column:
    """The URL shown for a server: its own, or ``stdio:command[name or first argument]``."""
    first = F.when(F.size("args") > 0, F.element_at("args", 1)).otherwise(F.lit("unknown"))
    label = F.when(c("name").isNotNull(), c("name")).when(c("args").isNotNull(), first)
    stdio = F.when(label.isNotNull(), F.concat(F.lit("stdio:"), c("command"), F.lit("["), label, F.lit("]"))).otherwise(F.concat(F.lit("stdio:"), c("command")))
    return F.coalesce(c("url"), F.when(c("command").isNotNull(), stdio), F.lit("unknown"))


def classify_transport(configs: DataFrame) -> DataFrame:
    """transport, display URL, and command and arguments split out of ``stdio:`` URLs."""
    url = F.col("url")
    is_stdio = F.coalesce(F.startswith(url, F.lit("stdio:")), F.lit(False))
    parts = F.split(url, ":", 3)
    stdio_command = F.regexp_replace(F.element_at(parts, 2), "^(//)+", "")
    stdio_args = F.when((F.size(parts) > 2) & (F.element_at(parts, -1) != ""), F.split(F.element_at(parts, -1), ":")).otherwise(F.array().cast("array<string>"))
    transport = F.when(is_stdio, "stdio").when(url.isNotNull(), "http").when(F.col("command").isNotNull(), "stdio").otherwise("invalid")
    return (
        configs.withColumn("transport", transport).withColumn("display_url", display_url())
        .withColumn("run_command", F.when(is_stdio, stdio_command).otherwise(F.col("command")))
        .withColumn("run_args", F.when(is_stdio, stdio_args).otherwise(F.col("args")))
    )
