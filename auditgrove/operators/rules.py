"""Rule matching: pattern hits, rule findings, their annotation, phase summaries and operator chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditgrove.operators.catalog import BUILT_IN, RULES, Catalog, condition_column, hit_column, met_literals, rules_of
from auditgrove.operators.items import display_url, env_values

#: Context sentence of a rule; ``{}`` is the kind of item.
CONTEXTS = {
    "SecretsLeakage": "Potential secret exposure detected in {}",
    "SSHKeyExposure": "SSH key or configuration file access detected in {}",
    "PEMFileAccess": "PEM certificate or private key access detected in {}",
    "EnvironmentVariableLeakage": "Sensitive environment variable pattern detected in {}",
    "CrossOriginEscalation": "Cross-origin escalation vulnerability detected in {}",
    "CrossDomainContamination": "Cross-domain contamination detected across multiple domains in {}",
    "DomainOutlier": "Domain outlier detected - {} uses different domain than majority",
    "MixedSecuritySchemes": "Mixed HTTP/HTTPS schemes detected in {}",
    "CommandInjection": "Command injection vulnerability detected in {}",
}
#: The rules whose findings name a rule file.
RULE_FILES = {
    "SecretsLeakage": "secrets_leakage", "SSHKeyExposure": "secrets_leakage", "PEMFileAccess": "secrets_leakage", "EnvironmentVariableLeakage": "secrets_leakage",
    "CrossOriginEscalation": "cross_origin_escalation", "CrossDomainContamination": "cross_origin_escalation", "DomainOutlier": "cross_origin_escalation", "MixedSecuritySchemes": "cross_origin_escalation",
}
HAYSTACKS = {"full": "full_text", "name": "scan_text"}


def bound(items: DataFrame, text: str, *columns: str, catalog: Catalog = BUILT_IN, phase: str | None = None) -> DataFrame:
    """The columns kept, the text and the gate literals that stand in it, each computed once per row: the tests above refer to them."""
    return items.select(*columns, F.col(text).alias("text_"), met_literals(F.col(text), catalog, rules_of(phase, catalog)).alias("met_"))


def found_in(rule: str, pattern_id: str, catalog: Catalog) -> Column:
    return hit_column(rule, pattern_id, F.col("text_"), F.col("met_"), catalog)


def pattern_hits(items: DataFrame, phase: str = "pre", haystack: str = "full", catalog: Catalog = BUILT_IN) -> DataFrame:
    """A row per item and pattern found in it."""
    source = bound(items, HAYSTACKS[haystack], "server", "item_id", catalog=catalog, phase=phase)
    hit = F.array_compact(F.array(*[F.when(found_in(r, p, catalog), F.struct(F.lit(r).alias("rule_name"), F.lit(p).alias("pattern_id"))) for r in rules_of(phase, catalog) for p in catalog.patterns[r]]))
    return source.select("server", "item_id", F.inline(hit))


def matched_rules(rules: list[str], catalog: Catalog) -> Column:
    """Array of the rules whose condition holds on the bound text. A condition stops at the first term that decides, so most
    patterns never run; it is exploded where it is made, so that no filter on it repeats the tests."""
    return F.array_compact(F.array(*[F.when(condition_column(catalog.conditions[r], lambda p, r=r: found_in(r, p, catalog)), F.lit(r)) for r in rules]))


def rule_matches(items: DataFrame, phase: str = "pre", haystack: str = "full", catalog: Catalog = BUILT_IN) -> DataFrame:
    """R2: a row per item and rule that matches it."""
    source = bound(items, HAYSTACKS[haystack], "server", "item_type", "item_id", "name", catalog=catalog, phase=phase)
    out = source.select("server", F.col("item_type").alias("target_type"), "item_id", F.col("name").alias("target_name"), F.explode(matched_rules(rules_of(phase, catalog), catalog)).alias("rule_name"))
    return out.withColumn("phase", F.lit(phase)).withColumn("status", F.lit("warning"))


def rule_files(catalog: Catalog) -> dict[str, str]:
    """Rule file of each rule that shows one: of the built-in rules those listed above, of added rules all."""
    return {r: v[0] for r, v in catalog.rules.items() if v[0] and r not in RULES} | RULE_FILES


def annotate_findings(findings: DataFrame, catalog: Catalog = BUILT_IN) -> DataFrame:
    """Rule file, context sentence and rule metadata; the lookups are literals, bounded by the catalog."""
    lookup = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("rule_name")]
    template = lookup(CONTEXTS)
    fallback = F.concat(F.col("target_type"), F.lit(" matched by security rule "), F.col("rule_name"))
    context = F.coalesce(F.replace(template, F.lit("{}"), F.col("target_type")), fallback)
    out = findings.withColumn("rule_file", lookup(rule_files(catalog))).withColumn("context", context)
    return out.withColumn("severity", lookup({r: v[5] for r, v in catalog.rules.items()})).withColumn("tags", F.split(lookup({r: v[6] for r, v in catalog.rules.items()}), ","))


def phase_summary(items: DataFrame, findings: DataFrame, phase: str = "pre", catalog: Catalog = BUILT_IN) -> DataFrame:
    """A row per server with items and matches counted, rules triggered, and passed or warning; clean servers count 0."""
    files = F.array(*[F.lit(f"{f}:*") for f in sorted({catalog.rules[r][0] for r in rules_of(phase, catalog)})])
    totals = items.groupBy("server").agg(F.count("*").alias("total_items_scanned"))
    rule_file = F.create_map(*[F.lit(x) for kv in rule_files(catalog).items() for x in kv])[F.col("rule_name")]
    label = F.coalesce(F.concat(rule_file, F.lit(":"), F.col("rule_name")), F.col("rule_name"))
    seen = findings.groupBy("server").agg(F.count("*").alias("total_matches"), F.array_sort(F.collect_set(label)).alias("security_issues_detected"))
    out = totals.join(seen, "server", "left").withColumn("total_matches", F.coalesce("total_matches", F.lit(0).cast("long")))
    out = out.withColumn("security_issues_detected", F.coalesce("security_issues_detected", F.array().cast("array<string>")))
    return out.withColumn("phase", F.lit(phase)).withColumn("rules_executed", files).withColumn("status", F.when(F.col("total_matches") == 0, "passed").otherwise("warning"))


def config_text() -> Column:
    """Text of a server definition that the rules read; absent fields give no line."""
    line = lambda label, c: F.concat(F.lit(label), c, F.lit("\n"))
    env = F.when(F.col("env").isNotNull(), F.concat(F.array_join(F.transform(env_values(F.col("env")), lambda v: F.concat(F.lit("ENV_VALUE:"), v, F.lit(" "))), ""), F.lit("\n")))
    parts = [line("NAME: ", F.col("name")), line("URL: ", F.col("url")), line("COMMAND: ", F.col("command")), line("ARGS: ", F.array_join("args", " ")), env, line("DESCRIPTION: ", F.col("description"))]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def config_rule_scan(configs: DataFrame, catalog: Catalog = BUILT_IN) -> DataFrame:
    """Findings of the pre-scan rules on server definitions."""
    named = configs.select("server_id", F.coalesce("name", display_url()).alias("target_name"), config_text().alias("config_text"))
    source = bound(named, "config_text", "server_id", "target_name", catalog=catalog, phase="pre")
    out = source.select("server_id", "target_name", F.explode(matched_rules(rules_of("pre", catalog), catalog)).alias("rule_name"))
    return annotate_findings(out.withColumn("target_type", F.lit("server")), catalog).withColumn("phase", F.lit("pre-config")).withColumn("status", F.lit("warning"))


def catalog_stats(rules: DataFrame, patterns: DataFrame) -> DataFrame:
    """Per phase the number of rules and patterns and the rule names."""
    sizes = patterns.groupBy("rule").agg(F.count("*").alias("n"))
    return rules.join(sizes, "rule", "left").groupBy("phase").agg(F.count("*").alias("n_rules"), F.sum("n").alias("n_patterns"), F.array_join(F.array_sort(F.collect_list("rule")), ",").alias("rules"))


def run_chain(items: DataFrame, operators: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """Union of the findings of all operators, in order; one that cannot be planned is skipped and reported."""
    out, failed = None, []
    for name, operator in operators:
        try:
            found = items.transform(operator).withColumn("operator", F.lit(name))
            found.schema  # noqa: B018  analysis happens here
        except Exception as e:  # noqa: BLE001  an operator of the user may fail in any way
            failed.append((name, str(e).splitlines()[0]))
            continue
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out, failed
