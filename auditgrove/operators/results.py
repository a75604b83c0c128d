"""Results: one list of findings, sorting, embedding, summaries, enrichment and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.functions.expressions import pick, severity_rank

FINDING_COLUMNS = ["server", "scan_type", "target_type", "item_id", "target_name", "finding_type", "severity", "message"]

#: Issue type -> (threat class, impact, ways in, remedy); our own wording.
THREATS = {
    "ToolPoisoning": ("malicious tool", "unauthorised actions or tampered data", "look-alike tools; compromised packages", "pin and review tool sources"),
    "SQLInjection": ("data injection", "data loss or disclosure", "crafted input fields; union and timing probes", "use bound parameters"),
    "CommandInjection": ("command execution", "takeover of the host", "shell characters in input; chained commands", "avoid shells and allow-list input"),
    "AuthBypass": ("authentication", "access to protected resources", "forged or missing credentials", "check rights on every call"),
    "PathTraversal": ("directory traversal", "disclosure of files", "parent-directory steps; encoded paths", "resolve paths below a fixed root"),
    "PromptInjection": ("model manipulation", "changed answers or leaked context", "instructions hidden in content", "separate instructions from content"),
    "Jailbreak": ("safety bypass", "unsafe output", "role play; staged requests", "filter input and output"),
    "SecretsLeakage": ("credential exposure", "misuse of keys", "secrets in text or logs", "rotate keys and use a vault"),
    "PIILeakage": ("personal data", "privacy violations", "personal data in content", "minimise and mask data"),
}
#: (issue type, severities) -> exploitability; anything else is medium.
EXPLOITABILITY = [
    (("SQLInjection", "CommandInjection", "AuthBypass"), ("CRITICAL",), "very high"), (("PathTraversal",), ("HIGH",), "high"), (("ToolPoisoning",), ("CRITICAL", "HIGH"), "high"),
    (("PromptInjection", "Jailbreak"), ("HIGH",), "medium-high"), (("SecretsLeakage",), ("HIGH",), "medium"), (("PIILeakage",), ("MEDIUM",), "medium"),
]
#: Rule id -> remedy.
RULE_REMEDIES = {
    "SecretsLeakage": "remove and rotate the credential", "EnvironmentVariableLeakage": "remove and rotate the credential", "SSHKeyExposure": "remove the key and reissue it", "PEMFileAccess": "remove the key and reissue it",
    "PathTraversalVulnerability": "resolve paths below a fixed root", "SQLInjection": "use bound parameters", "CommandInjection": "avoid shells and allow-list input", "CrossOriginEscalation": "serve a tool from one origin",
    "CrossDomainContamination": "serve a server's tools from one origin", "MCPConfigRisk": "start a fixed program without inline code",
}


def all_findings(issues: DataFrame, rule_findings: DataFrame) -> DataFrame:
    """A1: model issues and rule findings as one list; summaries are not findings."""
    model = issues.withColumn("scan_type", F.lit("llm_analysis")).withColumn("finding_type", F.col("issue_type"))
    rules = rule_findings.where("target_type <> 'summary'").withColumn("scan_type", F.lit("yara_rules")).withColumn("finding_type", F.col("rule_name")).withColumn("message", F.col("context"))
    return pick(model, FINDING_COLUMNS).unionByName(pick(rules, FINDING_COLUMNS))


def sort_by_severity(findings: DataFrame, k: int | None = None, missing: str = "LOW", then: tuple[str, ...] = ("server", "item_id", "finding_type")) -> DataFrame:
    """A2: most severe first, ties in a stated order; with ``k`` the first k rows, taken per partition before they meet."""
    out = findings.withColumn("severity", F.coalesce("severity", F.lit(missing))).orderBy(severity_rank(F.col("severity")), *then)
    return out if k is None else out.limit(k)


def embed_results(items: DataFrame, findings: DataFrame, details: DataFrame | None = None) -> DataFrame:
    """A3: items with the array of their findings, empty for clean ones, and with ``details`` (item_id, details) the model's analysis text.

    The items are joined last and move once; a wide text column is better left out and joined by item_id afterwards.
    """
    found = findings.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "scan_type", "finding_type", "severity", "message"))).alias("findings"))
    empty = F.array().cast(found.schema["findings"].dataType)
    if details is not None:
        texts = details.where("details is not null").groupBy("item_id").agg(F.array_join(F.array_sort(F.collect_list("details")), "\n").alias("analysis"))
        found = found.join(texts, "item_id", "full_outer")
    return items.join(found, "item_id", "left").withColumn("findings", F.coalesce("findings", empty))


def security_summary(servers: DataFrame, findings: DataFrame) -> DataFrame:
    """A4: per server the model issues by target type, rule issues and their sum; zeros where there are none."""
    model = lambda t: F.count(F.when((F.col("scan_type") == "llm_analysis") & (F.col("target_type") == t), 1)).alias(f"{t}_issues")
    per = findings.groupBy("server").agg(model("tool"), model("prompt"), model("resource"), F.count(F.when(F.col("scan_type") == "yara_rules", 1)).alias("rule_issues"), F.count("*").alias("total_issues"))
    return servers.select("server").distinct().join(per, "server", "left").na.fill(0)


def severity_rollup(findings: DataFrame, by: str = "scan_type") -> DataFrame:
    """A5: counts per severity for every (``by``, server), every ``by`` and in all, with critical and high flags."""
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s.lower())
    other = F.count(F.when(severity_rank(F.col("severity")) == 3, 1)).alias("low")
    out = findings.rollup(by, "server").agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"), other, F.grouping_id().alias("level"))
    return out.withColumn("has_critical", F.col("critical") > 0).withColumn("has_high", F.col("high") > 0)


def fleet_summary(scans: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: servers in all, succeeded and failed; items by type; servers with findings and findings in all."""
    ok = F.col("status") == "Success"
    s = scans.agg(F.count("*").alias("servers"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"))
    i = items.agg(*[F.count_if(F.col("item_type") == t).alias(f"{t}s") for t in ("tool", "resource", "prompt")])
    f = findings.groupBy("server").agg(F.count("*").alias("n")).agg(F.count("*").alias("servers_with_warnings"), F.coalesce(F.sum("n"), F.lit(0)).alias("warnings"))
    return s.crossJoin(i).crossJoin(f).withColumn("all_ok", F.col("failed") == 0)  # one row each


def results_by_source(scans: DataFrame) -> DataFrame:
    """Per client source, in order, the servers scanned and how many of their scans failed."""
    source = F.coalesce("ide_source", F.lit("UNKNOWN IDE"))
    per = scans.groupBy(source.alias("source"), "server").agg(F.count("*").alias("scans"), F.count_if(F.col("status") != "Success").alias("failed"))
    return per.groupBy("source").agg(F.count("*").alias("n_servers"), F.sum("scans").alias("scans"), F.sum("failed").alias("failed"), F.array_join(F.array_sort(F.collect_list("server")), ",").alias("servers")).orderBy("source")


def items_with_issues(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Items that have a finding."""
    return items.join(findings.select("item_id").distinct(), "item_id", "left_semi")


def items_passed(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Items without one."""
    return items.join(findings.select("item_id").distinct(), "item_id", "left_anti")


def issue_counts(items: DataFrame, findings: DataFrame) -> DataFrame:
    """Per server items in all, items with findings, and findings."""
    per_item = findings.groupBy("item_id").agg(F.count("*").alias("n"))
    return items.select("server", "item_id").join(per_item, "item_id", "left").groupBy("server").agg(F.count("*").alias("items"), F.count("n").alias("with_issues"), F.coalesce(F.sum("n"), F.lit(0)).alias("warnings"))


def enrich(findings: DataFrame) -> DataFrame:
    """Threat class, impact, ways in, remedy and exploitability; the lookups are literals of fixed size."""
    part = lambda i: F.create_map(*[F.lit(x) for k, t in THREATS.items() for x in (k, t[i])])[F.col("finding_type")]
    remedy = F.create_map(*[F.lit(x) for kv in RULE_REMEDIES.items() for x in kv])[F.col("finding_type")]
    how: Column = F.lit("medium")
    for types, severities, text in reversed(EXPLOITABILITY):
        how = F.when(F.col("finding_type").isin(*types) & F.col("severity").isin(*severities), text).otherwise(how)
    is_rule = F.col("scan_type") == "yara_rules"
    return (
        findings.withColumn("threat", F.when(~is_rule, part(0))).withColumn("impact", F.when(~is_rule, part(1))).withColumn("vectors", F.when(~is_rule, part(2)))
        .withColumn("remedy", F.when(is_rule, F.coalesce(remedy, F.lit("review the match and validate input"))).otherwise(part(3))).withColumn("exploitability", F.when(~is_rule, how))
    )


def remedy_column() -> Column:
    """The remedy of a finding: of its rule for rule detections, of its issue type for model issues."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("finding_type")]
    return F.when(F.col("scan_type") == "yara_rules", F.coalesce(pairs(RULE_REMEDIES), F.lit("review the match and validate input"))).otherwise(pairs({k: t[3] for k, t in THREATS.items()}))


def report_lines(scans: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """A10: every report as lines, with ``server``, ``place``, ``rank``, ``item_id``, ``finding_type`` and ``line`` giving their order.

    All findings have their line, the most severe first; a failed server's report ends after its error. No row holds more than one finding or
    one server's counts, so a report may be larger than a row or a task. ``scans`` has one row per server.
    """
    kinds = {"llm_analysis": ("Model issues", 6), "yara_rules": ("Rule detections", 9)}
    found = findings.join(scans.where("status = 'Success'").select("server"), "server")
    lined = found.select("server", F.element_at(F.create_map(*[F.lit(x) for k, (_, p) in kinds.items() for x in (k, p + 2)]), F.col("scan_type")).alias("place"), severity_rank(F.col("severity")).alias("rank"), "item_id", "finding_type", finding_line().alias("line"))
    remedies = found.select("server", F.lit(14).alias("place"), F.concat(F.lit("- "), remedy_column()).alias("line")).where("line is not null").distinct()
    n = lambda c: F.coalesce(F.count(F.when(c, 1)), F.lit(0))
    totals = findings.groupBy("server").agg(*[n(F.col("scan_type") == k).alias(k) for k in kinds], n(F.col("severity") == "CRITICAL").alias("critical"), n(F.col("severity") == "HIGH").alias("high"))
    remedied = remedies.select("server").distinct().withColumn("remedied", F.lit(True))
    counts = items.groupBy("server").agg(F.count("*").alias("items"))
    rows = scans.select("server", "status", "status_detail").join(counts, "server", "left").join(totals, "server", "left").join(remedied, "server", "left")
    good, text = F.col("status") == "Success", lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    row = lambda place, line: F.struct(F.lit(place).alias("place"), line.alias("line"))
    blank = F.lit("")
    summary = F.concat(F.lit("Items: "), text("items"), F.lit(", model issues: "), text("llm_analysis"), F.lit(", rule detections: "), text("yara_rules"), F.lit(", critical: "), text("critical"), F.lit(", high: "), text("high"))
    head = [row(0, F.concat(F.lit("# Report for "), F.col("server"))), row(1, blank), row(2, F.concat(F.lit("Status: "), F.col("status"))), row(3, blank)]
    head.append(row(4, F.when(good, summary).otherwise(F.concat(F.lit("Error: "), F.trim(F.coalesce("status_detail", blank))))))
    for k, (title, place) in kinds.items():
        head += [F.when(good & (F.col(k) > 0), row(place, blank)), F.when(good & (F.col(k) > 0), row(place + 1, F.lit(f"## {title}")))]
    head += [F.when(F.col("remedied"), row(12, blank)), F.when(F.col("remedied"), row(13, F.lit("## Remediation")))]
    heads = rows.select("server", F.inline(F.array_compact(F.array(*head))))
    return lined.unionByName(heads, allowMissingColumns=True).unionByName(remedies, allowMissingColumns=True)


def finding_line() -> Column:
    name = F.coalesce("target_name", "item_id", F.lit("?"))
    return F.concat(F.lit("- **"), F.coalesce("severity", F.lit("LOW")), F.lit("** "), "finding_type", F.lit(" on "), name, F.lit(": "), F.coalesce("message", F.lit("")))


def report_markdown(scans: DataFrame, items: DataFrame, findings: DataFrame, lines: int | None = None) -> DataFrame:
    """A10: one markdown text per server; a failed server's report ends after its error.

    A report counts and shows all findings, the most severe first, and lists every remedy once. With ``lines`` it shows that many model issues and as many rule
    detections at most; the top lines are then chosen per partition before they meet. A text is one row; reports of servers with very many findings are written
    line by line (``report_lines``). ``scans`` has one row per server.
    """
    line, rank = finding_line(), severity_rank(F.col("severity"))
    first = F.row_number().over(Window.partitionBy("server", "scan_type").orderBy("rank", "item_id", "finding_type", "line"))
    top = findings.select("server", "scan_type", "item_id", "finding_type", rank.alias("rank"), line.alias("line")).withColumn("n", first)
    top = top if lines is None else top.where(F.col("n") <= lines)
    part = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("scan_type") == kind, F.struct("n", "line")))), lambda s: s["line"]), "\n")
    shown = top.groupBy("server").agg(part("llm_analysis").alias("model_lines"), part("yara_rules").alias("rule_lines"))
    n = lambda c: F.count(F.when(c, 1))
    totals = findings.withColumn("remedy", remedy_column()).groupBy("server", "scan_type", "remedy").agg(F.count("*").alias("n"), n(F.col("severity") == "CRITICAL").alias("critical"), n(F.col("severity") == "HIGH").alias("high"))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("scan_type") == kind, F.col("n"))), F.lit(0))
    totals = totals.groupBy("server").agg(of("llm_analysis").alias("model_n"), of("yara_rules").alias("rule_n"), F.sum("critical").alias("critical"), F.sum("high").alias("high"), F.array_join(F.transform(F.array_sort(F.collect_set("remedy")), lambda r: F.concat(F.lit("- "), r)), "\n").alias("remedies"))
    counts = items.groupBy("server").agg(F.count("*").alias("items"))
    rows = scans.select("server", "status", "status_detail").join(counts, "server", "left").join(totals, "server", "left").join(shown, "server", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("string")
    section = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n\n## {title}\n"), F.col(c))).otherwise("")
    head = F.concat(F.lit("# Report for "), "server", F.lit("\n\nStatus: "), "status")
    body = F.concat(
        F.lit("\n\nItems: "), text("items"), F.lit(", model issues: "), text("model_n"), F.lit(", rule detections: "), text("rule_n"), F.lit(", critical: "), text("critical"), F.lit(", high: "), text("high"),
        section("Model issues", "model_lines"), section("Rule detections", "rule_lines"), section("Remediation", "remedies"),
    )
    failed = F.concat(F.lit("\n\nError: "), F.trim(F.coalesce("status_detail", F.lit(""))))
    return rows.select("server", F.concat(head, F.when(F.col("status") == "Success", body).otherwise(failed)).alias("report"))


def executive_summary(scans: DataFrame, items: DataFrame, findings: DataFrame) -> DataFrame:
    """A10: one markdown text over all servers: how many were scanned, and findings by kind and severity. Counts only; one row."""
    fleet = fleet_summary(scans, items, findings)
    n = lambda kind, s: F.count_if((F.col("scan_type") == kind) & ((F.col("severity") == s) if s != "LOW" else (severity_rank(F.col("severity")) == 3))).alias(f"{kind}_{s}")
    kinds = {"llm_analysis": "Model issues", "yara_rules": "Rule detections"}
    levels = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
    by = findings.agg(*[n(k, s) for k in kinds for s in levels])
    shown = lambda c: F.col(c).cast("string")
    lines = [F.concat(F.lit("# Executive summary\n\nServers: "), shown("servers"), F.lit(", succeeded: "), shown("succeeded"), F.lit(", failed: "), shown("failed"), F.lit(", with findings: "), shown("servers_with_warnings"))]
    for k, title in kinds.items():
        lines.append(F.concat(F.lit(f"{title}: "), F.concat_ws(", ", *[F.concat(F.lit(f"{s.lower()} "), shown(f"{k}_{s}")) for s in levels])))
    return fleet.crossJoin(by).select(F.concat_ws("\n", *lines).alias("summary"))  # one row each


def scan_coverage(items: DataFrame) -> DataFrame:
    """Assessment groups that ran per server, given the kinds of item it has."""
    has = items.groupBy("server").agg(*[F.bool_or(F.col("item_type") == t).alias(t) for t in ("tool", "prompt", "resource")])
    groups = F.array_compact(F.array(F.when(F.col("tool"), "tool security"), F.when(F.col("prompt"), "input security"), F.when(F.col("resource"), "resource security")))
    return has.select("server", groups.alias("groups"))
