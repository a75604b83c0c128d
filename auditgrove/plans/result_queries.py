"""Registered queries of the result operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrove.operators import model, results
from auditgrove.plans.audit_queries import ISSUES_SQL, issues, replies
from auditgrove.plans.rule_queries import FINDINGS_SQL, RANK_SQL, SCANS_SQL, all_items, findings, quote, scans
from auditgrove.sources import writers

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


EVERY_SQL = FINDINGS_SQL + ", " + ISSUES_SQL + """, every AS (
 SELECT 'chat' || (CAST(split_part(reply_id, '_', 1) AS BIGINT) % 10) AS server, 'llm_analysis' AS scan_type, 'prompt' AS target_type, 'p' || reply_id AS item_id, target_name, issue_type AS finding_type, severity, message FROM norm
 UNION ALL SELECT server, 'yara_rules', target_type, item_id, target_name, rule_name, severity, context FROM findings)"""


def every(spark, sf_dir):
    """All findings, stored once by the query that asks."""
    conv = F.split("reply_id", "_")[0].cast("long")
    model = issues(spark, sf_dir).withColumn("server", F.concat(F.lit("chat"), (conv % 10).cast("string"))).withColumn("target_type", F.lit("prompt")).withColumn("item_id", F.concat(F.lit("p"), "reply_id"))
    return writers.stored(results.all_findings(model, findings(spark, sf_dir)))


@register("a1_all_findings", f"WITH {EVERY_SQL} SELECT * FROM every")
def a1_all_findings(spark, sf_dir):
    return every(spark, sf_dir)


@register("a2_top_findings", f"WITH {EVERY_SQL} SELECT server, item_id, finding_type, severity FROM every ORDER BY {RANK_SQL}, server, item_id, finding_type LIMIT 100")
def a2_top_findings(spark, sf_dir):
    return results.sort_by_severity(every(spark, sf_dir), 100).select("server", "item_id", "finding_type", "severity")


DETAILS_SQL = "details AS (SELECT 'p' || reply_id AS item_id, string_agg(details, chr(10) ORDER BY details) AS analysis FROM parsed WHERE kind = 'details' GROUP BY reply_id)"


def details(spark, sf_dir):
    """Analysis texts of the model's replies by item."""
    return model.parse_responses(replies(spark, sf_dir)).where("kind = 'details'").select(F.concat(F.lit("p"), "reply_id").alias("item_id"), "details")


@register("a3_embedded_results", f"WITH {EVERY_SQL}, {DETAILS_SQL}, f AS (SELECT item_id, count(*) AS n, string_agg(finding_type, ',' ORDER BY {RANK_SQL}, scan_type, finding_type, severity, message) AS types FROM every GROUP BY item_id) SELECT items.item_id, items.server, coalesce(n, 0) AS n_findings, coalesce(types, '') AS types, coalesce(analysis, '') AS analysis FROM items LEFT JOIN f USING (item_id) LEFT JOIN details USING (item_id)")
def a3_embedded_results(spark, sf_dir):
    got = results.embed_results(all_items(spark, sf_dir).select("item_id", "server"), every(spark, sf_dir), details(spark, sf_dir))
    return got.select("item_id", "server", F.size("findings").cast("long").alias("n_findings"), F.array_join(F.transform("findings", lambda f: f["finding_type"]), ",").alias("types"), F.coalesce("analysis", F.lit("")).alias("analysis"))


@register("a4_security_summary", f"WITH {EVERY_SQL}, s AS (SELECT DISTINCT server FROM items), c AS (SELECT server, " + ", ".join(f"count(*) FILTER (scan_type = 'llm_analysis' AND target_type = '{t}') AS {t}_issues" for t in ("tool", "prompt", "resource")) + ", count(*) FILTER (scan_type = 'yara_rules') AS rule_issues, count(*) AS total_issues FROM every GROUP BY server) SELECT server, coalesce(tool_issues, 0) AS tool_issues, coalesce(prompt_issues, 0) AS prompt_issues, coalesce(resource_issues, 0) AS resource_issues, coalesce(rule_issues, 0) AS rule_issues, coalesce(total_issues, 0) AS total_issues FROM s LEFT JOIN c USING (server)")
def a4_security_summary(spark, sf_dir):
    return results.security_summary(all_items(spark, sf_dir), every(spark, sf_dir))


ROLLUP_SQL = f"SELECT scan_type, server, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER ({RANK_SQL} = 3) AS low, count(*) FILTER (severity = 'CRITICAL') > 0 AS has_critical, count(*) FILTER (severity = 'HIGH') > 0 AS has_high FROM every GROUP BY ROLLUP (scan_type, server)"


@register("a5_severity_rollup", f"WITH {EVERY_SQL} {ROLLUP_SQL}")
def a5_severity_rollup(spark, sf_dir):
    return results.severity_rollup(every(spark, sf_dir)).drop("level")


@register("a6_fleet_summary", f"WITH {EVERY_SQL}, {SCANS_SQL}, s AS (SELECT count(*) AS servers, count(*) FILTER (status = 'Success') AS succeeded, count(*) FILTER (status <> 'Success') AS failed FROM scans), i AS (SELECT count(*) FILTER (item_type = 'tool') AS tools, count(*) FILTER (item_type = 'resource') AS resources, count(*) FILTER (item_type = 'prompt') AS prompts FROM items), f AS (SELECT count(DISTINCT server) AS servers_with_warnings, count(*) AS warnings FROM every) SELECT s.*, i.*, f.*, failed = 0 AS all_ok FROM s, i, f")
def a6_fleet_summary(spark, sf_dir):
    return results.fleet_summary(scans(spark, sf_dir), all_items(spark, sf_dir), every(spark, sf_dir))


@register("a7_by_source", f"WITH {SCANS_SQL}, p AS (SELECT coalesce(ide_source, 'UNKNOWN IDE') AS source, server, count(*) AS scans, count(*) FILTER (status <> 'Success') AS failed FROM scans GROUP BY ALL) SELECT source, count(*) AS n_servers, CAST(sum(scans) AS BIGINT) AS scans, CAST(sum(failed) AS BIGINT) AS failed, string_agg(server, ',' ORDER BY server) AS servers FROM p GROUP BY source")
def a7_by_source(spark, sf_dir):
    return results.results_by_source(scans(spark, sf_dir))


@register("a8_issue_counts", f"WITH {EVERY_SQL}, f AS (SELECT item_id, count(*) AS n FROM every GROUP BY item_id) SELECT server, count(*) AS items, count(n) AS with_issues, CAST(coalesce(sum(n), 0) AS BIGINT) AS warnings FROM items LEFT JOIN f USING (item_id) GROUP BY server")
def a8_issue_counts(spark, sf_dir):
    return results.issue_counts(all_items(spark, sf_dir), every(spark, sf_dir))


@register("a8_items_passed", f"WITH {EVERY_SQL} SELECT 'passed' AS part, item_id FROM items WHERE item_id NOT IN (SELECT item_id FROM every) UNION ALL SELECT 'flagged', item_id FROM items WHERE item_id IN (SELECT item_id FROM every)")
def a8_items_passed(spark, sf_dir):
    items, found = all_items(spark, sf_dir), every(spark, sf_dir)
    part = lambda df, name: df.select(F.lit(name).alias("part"), "item_id")
    return part(results.items_passed(items, found), "passed").unionByName(part(results.items_with_issues(items, found), "flagged"))


def lookup_sql(values: dict[str, str]) -> str:
    return "CASE finding_type " + " ".join(f"WHEN '{k}' THEN {quote(t)}" for k, t in values.items()) + " END"


HOW_SQL = "CASE " + " ".join(f"WHEN finding_type IN ({', '.join(map(quote, t))}) AND severity IN ({', '.join(map(quote, s))}) THEN '{x}'" for t, s, x in results.EXPLOITABILITY) + " ELSE 'medium' END"
THREAT_SQL = [lookup_sql({k: t[i] for k, t in results.THREATS.items()}) for i in range(4)]


@register("a9_enriched", f"WITH {EVERY_SQL} SELECT item_id, finding_type, severity, CASE WHEN scan_type = 'llm_analysis' THEN {THREAT_SQL[0]} END AS threat, CASE WHEN scan_type = 'llm_analysis' THEN {THREAT_SQL[1]} END AS impact, CASE WHEN scan_type = 'llm_analysis' THEN {THREAT_SQL[3]} ELSE coalesce({lookup_sql(results.RULE_REMEDIES)}, 'review the match and validate input') END AS remedy, CASE WHEN scan_type = 'llm_analysis' THEN {HOW_SQL} END AS exploitability FROM every")
def a9_enriched(spark, sf_dir):
    return results.enrich(every(spark, sf_dir)).select("item_id", "finding_type", "severity", "threat", "impact", "remedy", "exploitability")


REMEDY_SQL = f"CASE WHEN scan_type = 'llm_analysis' THEN {THREAT_SQL[3]} ELSE coalesce({lookup_sql(results.RULE_REMEDIES)}, 'review the match and validate input') END"
REPORT_SQL = f"""WITH {EVERY_SQL}, sv AS (SELECT DISTINCT server, CASE WHEN length(server) % 2 = 1 THEN 'Failed' ELSE 'Success' END AS status FROM items),
 c AS (SELECT server, count(*) AS items FROM items GROUP BY server),
 lined AS (SELECT server, scan_type, severity, {RANK_SQL} AS place, item_id, finding_type, {REMEDY_SQL} AS remedy, '- **' || severity || '** ' || finding_type || ' on ' || coalesce(target_name, item_id, '?') || ': ' || coalesce(message, '') AS line FROM every),
 t AS (SELECT server, count(*) FILTER (scan_type = 'llm_analysis') AS model_n, count(*) FILTER (scan_type = 'yara_rules') AS rule_n, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, string_agg(DISTINCT '- ' || remedy, chr(10) ORDER BY '- ' || remedy) AS remedies FROM lined GROUP BY server),
 top AS (SELECT *, row_number() OVER (PARTITION BY server, scan_type ORDER BY place, item_id, finding_type, line) AS n FROM lined QUALIFY n <= 100),
 l AS (SELECT server, string_agg(line, chr(10) ORDER BY n) FILTER (scan_type = 'llm_analysis') AS model_lines, string_agg(line, chr(10) ORDER BY n) FILTER (scan_type = 'yara_rules') AS rule_lines FROM top GROUP BY server)
SELECT server, '# Report for ' || server || chr(10) || chr(10) || 'Status: ' || status || chr(10) || chr(10) || CASE WHEN status = 'Success' THEN
  'Items: ' || coalesce(items, 0) || ', model issues: ' || coalesce(model_n, 0) || ', rule detections: ' || coalesce(rule_n, 0) || ', critical: ' || coalesce(critical, 0) || ', high: ' || coalesce(high, 0)
  || coalesce(chr(10) || chr(10) || '## Model issues' || chr(10) || model_lines, '') || coalesce(chr(10) || chr(10) || '## Rule detections' || chr(10) || rule_lines, '') || coalesce(chr(10) || chr(10) || '## Remediation' || chr(10) || remedies, '')
 ELSE 'Error: down' END AS report FROM sv LEFT JOIN c USING (server) LEFT JOIN t USING (server) LEFT JOIN l USING (server)"""


@register("a10_reports", REPORT_SQL)
def a10_reports(spark, sf_dir):
    items = all_items(spark, sf_dir)
    status = items.select("server", F.when(F.length("server") % 2 == 1, "Failed").otherwise("Success").alias("status"), F.lit(" down ").alias("status_detail")).distinct()
    return results.report_markdown(status, items, every(spark, sf_dir), lines=100)


LINES_SQL = f"""WITH {EVERY_SQL}, sv AS (SELECT DISTINCT server, CASE WHEN length(server) % 2 = 1 THEN 'Failed' ELSE 'Success' END AS status FROM items),
 c AS (SELECT server, count(*) AS items FROM items GROUP BY server),
 x AS (SELECT e.*, {REMEDY_SQL} AS remedy FROM every e),
 t AS (SELECT server, count(*) FILTER (scan_type = 'llm_analysis') AS m, count(*) FILTER (scan_type = 'yara_rules') AS r, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(remedy) AS remedies FROM x GROUP BY server),
 g AS (SELECT server, status, items, coalesce(m, 0) AS m, coalesce(r, 0) AS r, coalesce(critical, 0) AS critical, coalesce(high, 0) AS high, coalesce(remedies, 0) AS remedies FROM sv LEFT JOIN c USING (server) LEFT JOIN t USING (server)),
 h AS (SELECT server, 0 AS place, '# Report for ' || server AS line FROM g UNION ALL SELECT server, 1, '' FROM g UNION ALL SELECT server, 2, 'Status: ' || status FROM g UNION ALL SELECT server, 3, '' FROM g
  UNION ALL SELECT server, 4, CASE WHEN status = 'Success' THEN 'Items: ' || items || ', model issues: ' || m || ', rule detections: ' || r || ', critical: ' || critical || ', high: ' || high ELSE 'Error: down' END FROM g
  UNION ALL SELECT server, unnest([6, 7]), unnest(['', '## Model issues']) FROM g WHERE status = 'Success' AND m > 0 UNION ALL SELECT server, unnest([9, 10]), unnest(['', '## Rule detections']) FROM g WHERE status = 'Success' AND r > 0
  UNION ALL SELECT server, unnest([12, 13]), unnest(['', '## Remediation']) FROM g WHERE status = 'Success' AND remedies > 0),
 b AS (SELECT x.server, CASE WHEN scan_type = 'llm_analysis' THEN 8 ELSE 11 END AS place, '- **' || severity || '** ' || finding_type || ' on ' || coalesce(target_name, item_id, '?') || ': ' || coalesce(message, '') AS line, remedy FROM x JOIN sv ON sv.server = x.server AND status = 'Success')
SELECT server, place, line FROM h UNION ALL SELECT server, place, line FROM b UNION ALL SELECT DISTINCT server, 14, '- ' || remedy FROM b WHERE remedy IS NOT NULL"""


@register("a10_report_lines", LINES_SQL)
def a10_report_lines(spark, sf_dir):
    """All lines of all reports."""
    items = all_items(spark, sf_dir)
    status = items.select("server", F.when(F.length("server") % 2 == 1, "Failed").otherwise("Success").alias("status"), F.lit(" down ").alias("status_detail")).distinct()
    return results.report_lines(status, items, every(spark, sf_dir)).select("server", "place", "line")


SUMMARY_PARTS = {k: ", ".join(f"count(*) FILTER (scan_type = '{k}' AND {c}) AS {k}_{n}" for n, c in (("c", "severity = 'CRITICAL'"), ("h", "severity = 'HIGH'"), ("m", "severity = 'MEDIUM'"), ("l", f"{RANK_SQL} = 3"))) for k in ("llm_analysis", "yara_rules")}


@register("a10_summary", f"""WITH {EVERY_SQL}, {SCANS_SQL}, s AS (SELECT count(*) AS servers, count(*) FILTER (status = 'Success') AS ok, count(*) FILTER (status <> 'Success') AS bad FROM scans),
 f AS (SELECT count(DISTINCT server) AS warned, {SUMMARY_PARTS['llm_analysis']}, {SUMMARY_PARTS['yara_rules']} FROM every)
 SELECT '# Executive summary' || chr(10) || chr(10) || 'Servers: ' || servers || ', succeeded: ' || ok || ', failed: ' || bad || ', with findings: ' || warned || chr(10) || 'Model issues: critical ' || llm_analysis_c || ', high ' || llm_analysis_h || ', medium ' || llm_analysis_m || ', low ' || llm_analysis_l || chr(10) || 'Rule detections: critical ' || yara_rules_c || ', high ' || yara_rules_h || ', medium ' || yara_rules_m || ', low ' || yara_rules_l AS summary FROM s, f""")
def a10_summary(spark, sf_dir):
    return results.executive_summary(scans(spark, sf_dir), all_items(spark, sf_dir), every(spark, sf_dir))


@register("a11_coverage", "SELECT source AS server, 'tool security' AS groups FROM documents GROUP BY source UNION ALL SELECT DISTINCT 'chat' || (conv_id % 10), 'input security' FROM conversations UNION ALL SELECT DISTINCT 'web' || (page_id % 10), 'resource security' FROM pages")
def a11_coverage(spark, sf_dir):
    return results.scan_coverage(all_items(spark, sf_dir)).withColumn("groups", F.array_join("groups", ","))


@register("flagship_rule_rollup", f"WITH {FINDINGS_SQL} SELECT server, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) AS total FROM findings GROUP BY server")
def flagship_rule_rollup(spark, sf_dir):
    n = lambda s: F.count(F.when(F.col("severity") == s, 1)).alias(s.lower())
    return findings(spark, sf_dir).groupBy("server").agg(n("CRITICAL"), n("HIGH"), n("MEDIUM"), F.count("*").alias("total"))
