"""Registered queries of the item and rule operators."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.operators import catalog, items, rules
from auditgrove.plans import views as v
from auditgrove.plans.views import CONFIG_TEXT_SQL, CONFIGS_SQL, DISPLAY_SQL, ENV_SQL, ITEMS_SQL

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def hits_sql(text: str, rules_: list[str]) -> str:
    cases = [f"CASE WHEN regexp_matches({text}, {quote(('(?i)' if nocase else '') + rx)}) THEN '{r}.{p}' END" for r in rules_ for p, (rx, nocase) in catalog.PATTERNS[r].items()]
    return "list_filter([" + ",\n".join(cases) + "], lambda x: x IS NOT NULL)"


#: The conditions once more, written by hand in terms of the patterns found; the Spark plan is made from the catalog's own.
CONDITION_SQL = {
    "CommandInjection": """(shell_separators AND (file_dangerous OR process_dangerous OR network_dangerous)) OR file_manipulation OR process_control OR network_tools OR command_chaining
      OR pipe_operators OR background_exec OR variable_substitution OR injection_patterns OR privilege_escalation OR data_exfil OR reverse_shell OR web_shell OR unsafe_file_ops
      OR dangerous_permissions OR wildcard_patterns OR suspicious_combo
      OR ((exec_functions OR python_exec OR node_exec OR php_exec OR java_exec) AND NOT legitimate_patterns) OR ((encoding_evasion OR obfuscation) AND shell_separators)""",
    "SQLInjection": """union_injection OR union_columns OR time_injection OR delay_patterns OR error_injection OR error_functions OR stacked_queries OR multiple_statements OR auth_bypass
      OR login_bypass OR sensitive_data OR (NOT legitimate_patterns AND (boolean_injection OR boolean_operators OR orm_bypass OR parameter_bypass OR blind_injection))
      OR (sql_keywords AND (sql_comments OR inline_comments OR boolean_injection OR mysql_injection OR postgresql_injection OR mssql_injection OR oracle_injection OR encoding_evasion
      OR hex_encoding OR unicode_encoding OR case_variation OR conditional_logic)) OR (data_exfil AND NOT safe_keywords)""",
    "PathTraversalVulnerability": """dot_dot_slash OR dot_dot_backslash OR encoded_dot_dot OR double_encoded OR etc_path OR root_path OR var_path OR proc_path OR sys_path OR windows_system OR windows_users
      OR ((file_read OR file_include) AND (dot_dot_slash OR dot_dot_backslash))""",
    "CrossOriginEscalation": """(multi_domain_1 AND NOT (legitimate_cdn OR legitimate_backup OR legitimate_loadbalancer)) OR mixed_local_remote_1 OR mixed_local_remote_2 OR port_escalation OR mixed_schemes_1
      OR mixed_schemes_2 OR mixed_ws_schemes OR subdomain_variations OR api_multi_domain OR proxy_patterns OR url_in_params OR service_domains OR tool_multi_origin OR url_array OR json_multi_origin""",
    "MCPConfigRisk": "(cmd_exec AND (arg_flag OR arg_tokens)) OR calc_exec",
    "SecretsLeakage": "assigned_secret OR access_key_id OR hosting_token OR bearer_header",
    "SSHKeyExposure": "ssh_directory OR ssh_key_file OR ssh_public_key",
    "PEMFileAccess": "pem_block OR pem_file",
    "EnvironmentVariableLeakage": "assigned_variable OR env_file",
}


def matched_sql(rules_: list[str]) -> str:
    found = lambda r: re.sub(r"\b[a-z]\w*\b", lambda m: f"list_contains(hits, '{r}.{m[0]}')", CONDITION_SQL[r])
    cases = [f"CASE WHEN {found(r)} THEN '{r}' END" for r in rules_]
    return "list_filter([" + ",\n".join(cases) + "], lambda x: x IS NOT NULL)"


PRE = catalog.rules_of("pre")
HITS_SQL = f"{ITEMS_SQL}, hits AS (SELECT server, item_type, item_id, name, {hits_sql('full_text', PRE)} AS hits FROM items)"
MATCH_SQL = f"{HITS_SQL}, matches AS (SELECT server, item_type AS target_type, item_id, name AS target_name, unnest({matched_sql(PRE)}) AS rule_name FROM hits)"


def case_sql(column: str, values: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN {quote(k)} THEN {x}" for k, x in values.items()) + f" ELSE {other} END"


CONTEXT_SQL = case_sql("rule_name", {k: f"replace({quote(x)}, '{{}}', target_type)" for k, x in rules.CONTEXTS.items()}, "target_type || ' matched by security rule ' || rule_name")
FILE_SQL = case_sql("rule_name", {k: quote(x) for k, x in rules.RULE_FILES.items()}, "NULL")
SEVERITY_SQL = case_sql("rule_name", {k: quote(x[5]) for k, x in catalog.RULES.items()}, "NULL")
RANK_SQL = "CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END"
FINDINGS_SQL = f"{MATCH_SQL}, findings AS (SELECT *, {FILE_SQL} AS rule_file, {CONTEXT_SQL} AS context, {SEVERITY_SQL} AS severity FROM matches)"


def all_items(spark, sf_dir) -> DataFrame:
    return items.to_items(v.tools(spark, sf_dir), v.prompts(spark, sf_dir), v.resources(spark, sf_dir))


def findings(spark, sf_dir) -> DataFrame:
    return rules.annotate_findings(rules.rule_matches(all_items(spark, sf_dir)))


@register("f1_items", f"WITH {ITEMS_SQL} SELECT item_type, item_type_plural, server, item_id, scan_text, length(full_text) AS full_chars FROM items")
def f1_items(spark, sf_dir):
    return all_items(spark, sf_dir).select("item_type", "item_type_plural", "server", "item_id", "scan_text", F.length("full_text").cast("long").alias("full_chars"))


@register("f2_filter_findings", f"WITH {FINDINGS_SQL} SELECT server, item_id, rule_name, severity FROM findings WHERE {RANK_SQL} <= 1 AND rule_name NOT IN ('SQLInjection')")
def f2_filter_findings(spark, sf_dir):
    checks = [c for c in items.CHECKS if c != "sql_injection"]
    return items.filter_findings(findings(spark, sf_dir), "HIGH", checks).select("server", "item_id", "rule_name", "severity")


@register("f3_split_summaries", f"WITH {FINDINGS_SQL}, s AS (SELECT DISTINCT server FROM items) SELECT 'match' AS part, server, count(*) AS n FROM findings GROUP BY server UNION ALL SELECT 'summary', server, 1 FROM s")
def f3_split_summaries(spark, sf_dir):
    every, found = all_items(spark, sf_dir), findings(spark, sf_dir)
    summaries = rules.phase_summary(every, found).select("server", F.lit("summary").alias("target_type"))
    match, _, summary = items.split_summaries(found.select("server", "target_type").unionByName(summaries))
    part = lambda df, name: df.groupBy("server").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "server", "n")
    return part(match, "match").unionByName(part(summary, "summary"))


@register("f4_env_values", f"WITH {CONFIGS_SQL}, x AS (SELECT server_id, {ENV_SQL} AS vals FROM configs) SELECT server_id, generate_subscripts(vals, 1) - 1 AS place, unnest(vals) AS value FROM x")
def f4_env_values(spark, sf_dir):
    return items.env_value_filter(v.configs(spark, sf_dir)).select("server_id", F.col("place").cast("long").alias("place"), "value")


SCANS_SQL = """scans AS (SELECT c_custkey AS scan_id, 'nation' || c_nationkey AS server, CASE c_custkey % 5 WHEN 0 THEN 'Success' WHEN 1 THEN 'Failed' WHEN 2 THEN 'Timeout' WHEN 3 THEN 'ConnectionError' ELSE 'AuthenticationError' END AS status,
 CASE c_custkey % 7 WHEN 0 THEN 'docker: mounts denied for /x' WHEN 1 THEN 'GITHUB_PERSONAL_ACCESS_TOKEN not set' WHEN 2 THEN ' exec: No such file or directory ' WHEN 3 THEN 'connection closed: initialize response' WHEN 4 THEN 'HTTP 401' WHEN 5 THEN ' other error ' ELSE NULL END AS status_detail,
 CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE 'ide' || (c_nationkey % 4) END AS ide_source FROM customer)"""


def scans(spark, sf_dir) -> DataFrame:
    body = SCANS_SQL[len("scans AS (SELECT ") : SCANS_SQL.rindex(" FROM customer")]
    return v.table(spark, sf_dir, "customer").createOrReplaceTempView("audit_customer") or spark.sql(f"SELECT {body} FROM audit_customer")


def needles(cols: str) -> str:
    out, hint = "'other'", "trim(coalesce(status_detail, ''))"
    for name, texts, text in reversed(items.TRIAGE):
        hit = "(" + " OR ".join(f"contains(coalesce(status_detail, ''), {quote(t)})" for t in texts) + f") AND status = '{'AuthenticationError' if name == 'unauthorized' else 'Failed'}'"
        out, hint = f"CASE WHEN {hit} THEN '{name}' ELSE {out} END", f"CASE WHEN {hit} THEN {quote(text)} ELSE {hint} END"
    return {"category": f"CASE WHEN status = 'Timeout' THEN 'timeout' ELSE {out} END", "hint": f"CASE WHEN status = 'Timeout' THEN 'increase the timeout' ELSE {hint} END"}[cols]


@register("f5_triage_failures", f"WITH {SCANS_SQL} SELECT category, hint, count(*) AS n FROM (SELECT {needles('category')} AS category, {needles('hint')} AS hint FROM scans WHERE status <> 'Success') GROUP BY category, hint")
def f5_triage_failures(spark, sf_dir):
    return items.triage_failures(scans(spark, sf_dir)).groupBy("category", "hint").agg(F.count("*").alias("n"))


@register("f6_transport", f"WITH {CONFIGS_SQL} SELECT server_id, CASE WHEN coalesce(starts_with(url, 'stdio:'), false) THEN 'stdio' WHEN url IS NOT NULL THEN 'http' WHEN command IS NOT NULL THEN 'stdio' ELSE 'invalid' END AS transport, {DISPLAY_SQL} AS display_url, CASE WHEN coalesce(starts_with(url, 'stdio:'), false) THEN split_part(url, ':', 2) ELSE command END AS run_command, CASE WHEN coalesce(starts_with(url, 'stdio:'), false) THEN replace(substr(url, length('stdio:' || split_part(url, ':', 2)) + 2), ':', ' ') ELSE array_to_string(args, ' ') END AS run_args FROM configs")
def f6_transport(spark, sf_dir):
    return items.classify_transport(v.configs(spark, sf_dir)).select("server_id", "transport", "display_url", "run_command", F.array_join("run_args", " ").alias("run_args"))


@register("r1_pattern_hits", f"WITH {HITS_SQL}, x AS (SELECT server, item_id, unnest(hits) AS hit FROM hits) SELECT server, item_id, split_part(hit, '.', 1) AS rule_name, split_part(hit, '.', 2) AS pattern_id FROM x")
def r1_pattern_hits(spark, sf_dir):
    return rules.pattern_hits(all_items(spark, sf_dir))


@register("r2_rule_matches", f"WITH {MATCH_SQL} SELECT *, 'pre' AS phase, 'warning' AS status FROM matches")
def r2_rule_matches(spark, sf_dir):
    return rules.rule_matches(all_items(spark, sf_dir))


BODIES_SQL = f"""bodies AS (SELECT 'web' || (page_id % 10) AS server, 'resource' AS item_type, 'r' || page_id AS item_id, 'page_' || page_id AS name, concat_ws(chr(10), 'RESOURCE: page_' || page_id, html, url) AS full_text FROM pages),
 hits AS (SELECT server, item_type, item_id, name, {hits_sql('full_text', PRE)} AS hits FROM bodies)"""


@register("r2_page_bodies", f"WITH {BODIES_SQL} SELECT server, item_id, unnest({matched_sql(PRE)}) AS rule_name FROM hits")
def r2_page_bodies(spark, sf_dir):
    """The rules on resources that bring their body."""
    pages = v.spread(spark, sf_dir, "pages", "page_id").selectExpr("'web' || (page_id % 10) AS server", "'r' || page_id AS item_id", "'page_' || page_id AS name", "url AS uri", "html AS description")
    return rules.rule_matches(items.to_items(resources=pages)).select("server", "item_id", "rule_name")


@register("r3_annotated_findings", f"WITH {FINDINGS_SQL} SELECT target_type, item_id, rule_name, rule_file, context, severity FROM findings")
def r3_annotated_findings(spark, sf_dir):
    return findings(spark, sf_dir).select("target_type", "item_id", "rule_name", "rule_file", "context", "severity")


@register("r4_phase_summary", f"WITH {FINDINGS_SQL}, n AS (SELECT server, count(*) AS total_items_scanned FROM items GROUP BY server), m AS (SELECT server, count(*) AS total_matches, string_agg(DISTINCT coalesce(rule_file || ':' || rule_name, rule_name), ',' ORDER BY coalesce(rule_file || ':' || rule_name, rule_name)) AS issues FROM findings GROUP BY server) SELECT server, total_items_scanned, coalesce(total_matches, 0) AS total_matches, coalesce(issues, '') AS issues, CASE WHEN total_matches IS NULL THEN 'passed' ELSE 'warning' END AS status FROM n LEFT JOIN m USING (server)")
def r4_phase_summary(spark, sf_dir):
    got = rules.phase_summary(all_items(spark, sf_dir), findings(spark, sf_dir))
    return got.select("server", "total_items_scanned", "total_matches", F.array_join("security_issues_detected", ",").alias("issues"), "status")


CONFIG_FINDINGS_SQL = f"{CONFIGS_SQL}, texts AS (SELECT server_id, coalesce(name, {DISPLAY_SQL}) AS target_name, {CONFIG_TEXT_SQL} AS config_text FROM configs), config_hits AS (SELECT server_id, target_name, {hits_sql('config_text', PRE)} AS hits FROM texts), config_matches AS (SELECT server_id, target_name, unnest({matched_sql(PRE)}) AS rule_name FROM config_hits)"


@register("r5_config_rules", f"WITH {CONFIG_FINDINGS_SQL} SELECT server_id, target_name, rule_name, {SEVERITY_SQL} AS severity, 'pre-config' AS phase FROM config_matches")
def r5_config_rules(spark, sf_dir):
    return rules.config_rule_scan(v.configs(spark, sf_dir)).select("server_id", "target_name", "rule_name", "severity", "phase")


@register("r7_chain", f"WITH {MATCH_SQL} SELECT 'rules' AS operator, server, item_id, rule_name FROM matches UNION ALL SELECT 'long', server, item_id, 'LongText' FROM items WHERE length(full_text) > 5000")
def r7_chain(spark, sf_dir):
    chain = [
        ("rules", rules.rule_matches),
        ("broken", lambda df: df.select("no_such_column")),
        ("long", lambda df: df.where("length(full_text) > 5000").select("server", "item_id", F.lit("LongText").alias("rule_name"))),
    ]
    return rules.run_chain(all_items(spark, sf_dir), chain)[0].select("operator", "server", "item_id", "rule_name")
