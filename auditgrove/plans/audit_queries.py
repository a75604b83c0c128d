"""Registered queries of the origin, model, drift and configuration operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrove.functions.storage import shared_folder
from auditgrove.operators import configs as cfg
from auditgrove.operators import drift, model, origins
from auditgrove.plans import views as v
from auditgrove.plans.rule_queries import all_items, quote
from auditgrove.plans.views import CONFIGS_SQL, ITEMS_SQL
from auditgrove.sources.baselines import BaselineStore

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


# ---- origins -----------------------------------------------------------------------------------------------------------

URLS_SQL = ITEMS_SQL + r""", urls AS (
 SELECT server, item_type, item_id, name, 'uri' AS field, uri AS url FROM items WHERE regexp_matches(uri, '^(https?|wss?)://')
 UNION ALL SELECT server, item_type, item_id, name, 'description', description FROM items WHERE regexp_matches(description, '^(https?|wss?)://')
 UNION ALL SELECT server, item_type, item_id, name, 'input_schema', unnest(regexp_extract_all(input_schema, '"((?:https?|wss?)://[^"]*)"', 1)) FROM items
 UNION ALL SELECT server, item_type, item_id, name, 'output_schema', unnest(regexp_extract_all(output_schema, '"((?:https?|wss?)://[^"]*)"', 1)) FROM items
 UNION ALL SELECT server, item_type, item_id, name, 'parameters', unnest(regexp_extract_all(parameters, '"((?:https?|wss?)://[^"]*)"', 1)) FROM items)"""
FACTS_SQL = URLS_SQL + r""", hosts AS (SELECT *, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme, lower(regexp_extract(url, '^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:\s]*)', 1)) AS host FROM urls),
 facts AS (SELECT *, CASE WHEN host = 'localhost' OR regexp_matches(host, '^[0-9.]+$') OR NOT contains(host, '.') THEN host ELSE split_part(host, '.', -2) || '.' || split_part(host, '.', -1) END AS root_domain FROM hosts WHERE host <> ''),
 per AS (SELECT server, root_domain, count(*) AS uses FROM facts GROUP BY ALL)"""


def facts(spark, sf_dir):
    return origins.url_facts(origins.extract_urls(all_items(spark, sf_dir)))


@register("x1_extract_urls", f"WITH {URLS_SQL} SELECT * FROM urls")
def x1_extract_urls(spark, sf_dir):
    return origins.extract_urls(all_items(spark, sf_dir))


@register("x2_url_facts", f"WITH {FACTS_SQL} SELECT item_id, field, url, scheme, host, root_domain FROM facts")
def x2_url_facts(spark, sf_dir):
    return facts(spark, sf_dir).select("item_id", "field", "url", "scheme", "host", "root_domain")


#: A manifest of every document: its text, nested links with escapes, links as keys; the same text in both engines.
MANIFEST_SQL = r"""concat('{"text":"', replace(replace(replace(coalesce(text, ''), chr(92), chr(92) || chr(92)), '"', chr(92) || '"'), chr(10), chr(92) || 'n'), '","links":[{"plain":"https://p', doc_id % 7, '.one.example/a"},[{"deep":{"er":["https:', chr(92), '/', chr(92), '/e', doc_id % 5, '.two.example', chr(92), '/b"]}}]],"',
 chr(92), 'u0068ttp://key', doc_id % 3, '.three.example":null,"quoted":"', chr(92), '"https://no.example', chr(92), '"","tail":"', chr(92), chr(92), '","ws":"wss://w', doc_id % 2, '.one.example","broken":', CASE WHEN doc_id % 11 = 0 THEN '' ELSE '0' END, '}')"""


@register("x1_json_walk", f"""WITH m AS (SELECT source AS server, 't' || doc_id AS item_id, {MANIFEST_SQL} AS j FROM documents),
 n AS (SELECT server, item_id, t.key, t.type, t.atom FROM m, json_tree(m.j) t WHERE json_valid(m.j)),
 s AS (SELECT server, item_id, atom ->> '$' AS url FROM n WHERE type = 'VARCHAR' UNION ALL SELECT server, item_id, key FROM n WHERE key IS NOT NULL)
 SELECT server, item_id, 'raw_json' AS field, url FROM s WHERE regexp_matches(url, '^(https?|wss?)://')""")
def x1_json_walk(spark, sf_dir):
    docs = v.spread(spark, sf_dir, "documents", "doc_id").selectExpr("source AS server", "'tool' AS item_type", "'t' || doc_id AS item_id", "'doc_' || doc_id AS name", f"{MANIFEST_SQL.replace('chr(92)', 'char(92)').replace('chr(10)', 'char(10)')} AS raw_json")
    return origins.extract_urls(docs).select("server", "item_id", "field", "url")


@register("x1_urls_anywhere", """SELECT 'web' || (page_id % 10) AS server, 'r' || page_id AS item_id, 'body' AS field, unnest(regexp_extract_all(url || ' ' || html, '((?:https?|wss?)://[^ \t\n\x0B\f\r"''<>]+)', 1)) AS url FROM pages""")
def x1_urls_anywhere(spark, sf_dir):
    pages = v.spread(spark, sf_dir, "pages", "page_id").selectExpr("'web' || (page_id % 10) AS server", "'resource' AS item_type", "'r' || page_id AS item_id", "'page_' || page_id AS name", "url || ' ' || html AS body")
    return origins.extract_urls(pages, "anywhere", fields=("body",)).select("server", "item_id", "field", "url")


#: A table of public suffixes, as a user would bring one.
SUFFIXES = ("example", "one.example", "two.example", "org", "co.example")


@register("x2_suffix_roots", f"""WITH {FACTS_SQL}, s AS (SELECT unnest({list(SUFFIXES)}) AS suffix), h AS (SELECT DISTINCT host FROM facts),
 l AS (SELECT host, max_by(suffix, length(suffix)) AS suffix FROM h JOIN s ON host = suffix OR ends_with(host, '.' || suffix) WHERE NOT regexp_matches(host, '^[0-9.]+$') GROUP BY host)
 SELECT item_id, field, url, host, CASE WHEN suffix IS NULL THEN root_domain WHEN host = suffix THEN host ELSE split_part(host[:length(host) - length(suffix) - 1], '.', -1) || '.' || suffix END AS root_domain FROM facts LEFT JOIN l USING (host)""")
def x2_suffix_roots(spark, sf_dir):
    suffixes = spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    return origins.url_facts(origins.extract_urls(all_items(spark, sf_dir)), suffixes).select("item_id", "field", "url", "host", "root_domain")


@register("x3_domain_distribution", f"WITH {FACTS_SQL} SELECT server, root_domain, count(*) AS uses, string_agg(DISTINCT item_type || ':' || name, ',' ORDER BY item_type || ':' || name) AS users FROM facts GROUP BY server, root_domain")
def x3_domain_distribution(spark, sf_dir):
    return origins.domain_distribution(facts(spark, sf_dir)).withColumn("users", F.array_join("users", ","))


@register("x3_domain_users", f"""WITH {FACTS_SQL} SELECT server, root_domain, item_type || ':' || name AS "user", count(*) AS uses FROM facts GROUP BY ALL""")
def x3_domain_users(spark, sf_dir):
    return origins.domain_users(facts(spark, sf_dir))


@register("x4_cross_domain", f"WITH {FACTS_SQL}, c AS (SELECT server, count(*) AS n_domains, string_agg(root_domain, ', ' ORDER BY root_domain) AS domains, CAST(sum(uses) AS BIGINT) AS total_uses FROM per GROUP BY server) SELECT *, 'CrossDomainContamination' AS rule_name, 'HIGH' AS severity, 'Cross-domain contamination detected across ' || n_domains || ' domains: ' || domains AS matched_text FROM c WHERE n_domains > 1")
def x4_cross_domain(spark, sf_dir):
    return origins.cross_domain_findings(facts(spark, sf_dir))


@register("x5_domain_outliers", f"WITH {FACTS_SQL}, common AS (SELECT server, root_domain AS common_domain FROM per QUALIFY row_number() OVER (PARTITION BY server ORDER BY uses DESC, root_domain) = 1) SELECT server, item_id, root_domain, common_domain, item_type || ':' || name || ' uses domain ''' || root_domain || ''' instead of common domain ''' || common_domain || '''' AS matched_text FROM facts JOIN common USING (server) WHERE root_domain <> common_domain")
def x5_domain_outliers(spark, sf_dir):
    return origins.domain_outliers(facts(spark, sf_dir)).select("server", "item_id", "root_domain", "common_domain", "matched_text")


@register("x6_mixed_schemes", f"WITH {FACTS_SQL} SELECT server, count(DISTINCT host) AS n_hosts, 'MixedSecuritySchemes' AS rule_name, 'MEDIUM' AS severity FROM facts GROUP BY server HAVING bool_or(scheme = 'http') AND bool_or(scheme = 'https')")
def x6_mixed_schemes(spark, sf_dir):
    return origins.mixed_schemes(facts(spark, sf_dir))


# ---- model -------------------------------------------------------------------------------------------------------------

CARDS_SQL = ITEMS_SQL + """, props AS (SELECT items.*, t.category, t.tags, json_extract(items.input_schema, '$.properties') AS p FROM items LEFT JOIN tools t USING (item_id)),
 cards AS (SELECT server, item_type, item_id, name, CASE item_type
  WHEN 'tool' THEN 'Description: ' || coalesce(description, 'No description') || chr(10) || 'Category: ' || coalesce(category, 'No category') || chr(10) || 'Tags: ' || array_to_string(tags, ', ') || chr(10) || 'Parameters: ' ||
   CASE WHEN input_schema IS NULL THEN 'no schema' WHEN p IS NULL THEN 'no properties' WHEN json_type(p) <> 'OBJECT' THEN 'complex schema' ELSE array_to_string(json_keys(p), ', ') END
  WHEN 'prompt' THEN 'Description: ' || coalesce(description, 'No description') || chr(10) || 'Arguments: No arguments'
  ELSE 'URI: ' || coalesce(uri, '') || chr(10) || 'Description: ' || coalesce(description, 'No description') END AS card FROM props)"""
TASK_SQL = "CASE item_type " + " ".join(f"WHEN '{k}' THEN {quote(t)}" for k, t in model.TASKS.items()) + " END"
BATCHES_SQL = CARDS_SQL + f""", placed AS (SELECT *, row_number() OVER (PARTITION BY server, item_type ORDER BY item_id) - 1 AS n FROM cards),
 batches AS (SELECT server, item_type, n // 10 AS batch_index, string_agg(name, ',' ORDER BY n) AS item_names, {TASK_SQL} || string_agg(chr(10) || chr(10) || upper(item_type) || ' ' || (n % 10 + 1) || ': ' || name || chr(10) || card, '' ORDER BY n) AS prompt FROM placed GROUP BY server, item_type, n // 10)"""


@register("l1_item_cards", f"WITH {CARDS_SQL} SELECT item_id, md5(card) AS card_md5 FROM cards")
def l1_item_cards(spark, sf_dir):
    return model.format_items(all_items(spark, sf_dir)).select("item_id", F.md5("card").alias("card_md5"))


@register("l2_prompt_batches", f"WITH {BATCHES_SQL} SELECT server, item_type, batch_index, item_names, md5(prompt) AS prompt_md5 FROM batches")
def l2_prompt_batches(spark, sf_dir):
    got = model.prompt_batches(model.format_items(all_items(spark, sf_dir)))
    return got.select("server", "item_type", "batch_index", F.array_join("item_names", ",").alias("item_names"), F.md5("prompt").alias("prompt_md5"))


def length_scorer(prompt: str) -> str:
    """Deterministic stand-in for a model."""
    if len(prompt) % 7 == 0:
        raise ValueError("no answer")
    return f'[{{"tool_name":"t","found_issue":{"true" if len(prompt) % 2 else "false"},"issues":[]}}]'


@register("l3_scored_batches", f"WITH {BATCHES_SQL} SELECT server, item_type, batch_index, CASE WHEN length(prompt) % 7 <> 0 THEN '[{{\"tool_name\":\"t\",\"found_issue\":' || CASE WHEN length(prompt) % 2 = 1 THEN 'true' ELSE 'false' END || ',\"issues\":[]}}]' END AS reply, CASE WHEN length(prompt) % 7 = 0 THEN 'no answer' END AS error FROM batches")
def l3_scored_batches(spark, sf_dir):
    return model.score_batches(model.prompt_batches(model.format_items(all_items(spark, sf_dir))), length_scorer)


REPLIES_EXPR = """CASE (conv_id * 7 + turn) % 8
 WHEN 0 THEN 'Sure: [{"tool_name":"tool' || turn || '","found_issue":true,"details":"seen","issues":[{"issue_type":"SQLInjection","severity":"critical","message":"m' || conv_id || '","details":"d"},{"issue_type":"Odd","severity":"HIGH","message":"x","details":"y"}]}] done'
 WHEN 1 THEN '[{"tool_name":"clean","found_issue":false,"details":"fine","issues":[{"issue_type":"Jailbreak","severity":"HIGH","message":"x","details":"y"}]}]'
 WHEN 2 THEN '[{"prompt_name":"p' || conv_id || '","issue_type":"Jailbreak","severity":"weird","message":"asks to ignore rules","details":"text"}]'
 WHEN 3 THEN '[]'
 WHEN 4 THEN 'no issues []'
 WHEN 5 THEN 'broken reply'
 WHEN 6 THEN '[{"tool_name":"nofound","issues":[]},{"resource_uri":"r://' || turn || '","issue_type":"PathTraversal","severity":"High","message":"dots","details":null}]'
 ELSE '[{"name":"n","issue_type":"PIILeakage","severity":"low","message":"mail","details":"address"}' END"""


def replies(spark, sf_dir):
    return v.table(spark, sf_dir, "conversations").selectExpr("conv_id || '_' || turn AS reply_id", f"{REPLIES_EXPR} AS reply")


PARSED_SQL = f"""replies AS (SELECT conv_id || '_' || turn AS reply_id, {REPLIES_EXPR} AS reply FROM conversations),
 bodies AS (SELECT *, CASE WHEN contains(reply, '[') AND contains(reply, ']') AND length(reply) - strpos(reverse(reply), ']') + 1 > strpos(reply, '[') THEN substr(reply, strpos(reply, '['), length(reply) - strpos(reverse(reply), ']') + 1 - strpos(reply, '[') + 1) ELSE reply END AS body FROM replies),
 good AS (SELECT *, json_valid(body) AND starts_with(ltrim(body), '[') AS good FROM bodies),
 elements AS (SELECT reply_id, unnest(json_extract(body, '$[*]')) AS e FROM good WHERE good),
 named AS (SELECT * FROM elements WHERE e->>'tool_name' IS NOT NULL AND e->>'found_issue' IS NOT NULL),
 issues AS (SELECT reply_id, e->>'tool_name' AS target_name, unnest(json_extract(e, '$.issues[*]')) AS i FROM named WHERE e->>'found_issue' = 'true'),
 parsed AS (
  SELECT reply_id, 'issue' AS kind, target_name, i->>'issue_type' AS issue_type, i->>'severity' AS severity, i->>'message' AS message, i->>'details' AS details FROM issues
  UNION ALL SELECT reply_id, 'details', e->>'tool_name', NULL, NULL, NULL, e->>'details' FROM named WHERE e->>'details' IS NOT NULL
  UNION ALL SELECT reply_id, 'issue', coalesce(e->>'prompt_name', e->>'resource_uri', e->>'name'), e->>'issue_type', e->>'severity', e->>'message', e->>'details' FROM elements WHERE e->>'tool_name' IS NULL
  UNION ALL SELECT reply_id, 'error', NULL, NULL, NULL, NULL, reply FROM good WHERE NOT good AND NOT contains(reply, '[]'))"""


@register("l4_parsed_replies", f"WITH {PARSED_SQL} SELECT * FROM parsed")
def l4_parsed_replies(spark, sf_dir):
    return model.parse_responses(replies(spark, sf_dir))


SENTENCE_SQL = "CASE issue_type " + " ".join(f"WHEN '{k}' THEN {quote(x[1])}" for k, x in model.ISSUE_TYPES.items()) + " END"
ISSUES_SQL = PARSED_SQL + f""", norm AS (SELECT reply_id, target_name, issue_type, CASE WHEN upper(severity) IN ('CRITICAL', 'HIGH', 'MEDIUM', 'LOW') THEN upper(severity) ELSE 'MEDIUM' END AS severity, {SENTENCE_SQL} || ': ' || message AS message, details FROM parsed
 WHERE kind = 'issue' AND severity IS NOT NULL AND message IS NOT NULL AND details IS NOT NULL AND issue_type IN ({', '.join(map(quote, model.ISSUE_TYPES))}))"""


def issues(spark, sf_dir):
    return model.normalise_issues(model.parse_responses(replies(spark, sf_dir)))


@register("l5_normal_issues", f"WITH {ISSUES_SQL} SELECT * FROM norm")
def l5_normal_issues(spark, sf_dir):
    return issues(spark, sf_dir).drop("kind")


# ---- drift -------------------------------------------------------------------------------------------------------------

OLD_EXPR = {"server": "source", "name": "'doc_' || doc_id", "description": "text", "input_schema": "'{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}'", "deprecated": "false"}
NEW_EXPR = OLD_EXPR | {"description": "CASE WHEN doc_id % 10 = 2 THEN text || ' changed' WHEN doc_id % 10 = 4 THEN NULL ELSE text END", "input_schema": "CASE WHEN doc_id % 10 = 3 THEN '{\"lang\":\"xx\",\"n\":' || n_chars || '}' WHEN doc_id % 10 = 5 THEN '{\"n\":' || n_chars || ',\"lang\":\"' || lang || '\"}' ELSE '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' END", "deprecated": "doc_id % 10 = 6"}


def snapshots(spark, sf_dir):
    docs = v.table(spark, sf_dir, "documents")
    old = docs.where("doc_id % 10 <> 0").selectExpr(*[f"{e} AS {c}" for c, e in OLD_EXPR.items()])
    new = docs.where("doc_id % 10 <> 1").selectExpr(*[f"{e} AS {c}" for c, e in NEW_EXPR.items()])
    return old, new


# keys in another order are the same JSON: the oracle writes both sides in one order
SNAP_SQL = "old AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in OLD_EXPR.items()) + " FROM documents WHERE doc_id % 10 <> 0), new AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in (NEW_EXPR | {"input_schema": "CASE WHEN doc_id % 10 = 3 THEN '{\"lang\":\"xx\",\"n\":' || n_chars || '}' ELSE '{\"lang\":\"' || lang || '\",\"n\":' || n_chars || '}' END"}).items()) + " FROM documents WHERE doc_id % 10 <> 1)"
CHANGES_SQL = SNAP_SQL + """, pairs AS (SELECT coalesce(o.server, n.server) AS server, coalesce(o.name, n.name) AS name, o.name AS oname, n.name AS nname, o.description AS od, n.description AS nd, o.input_schema AS oi, n.input_schema AS ni, o.deprecated AS odep, n.deprecated AS ndep FROM old o FULL JOIN new n ON o.server = n.server AND o.name = n.name),
 changes AS (SELECT server, name, 'added' AS change_type, NULL AS field, NULL AS old_value, NULL AS new_value, NULL AS diff FROM pairs WHERE oname IS NULL
  UNION ALL SELECT server, name, 'removed', NULL, NULL, NULL, NULL FROM pairs WHERE nname IS NULL
  UNION ALL SELECT server, name, 'modified', 'description', od, nd, CASE WHEN od IS NULL THEN 'description added' WHEN nd IS NULL THEN 'description removed' ELSE 'description changed' END FROM pairs WHERE oname IS NOT NULL AND nname IS NOT NULL AND od IS DISTINCT FROM nd
  UNION ALL SELECT server, name, 'modified', 'input_schema', oi, ni, CASE WHEN oi IS NULL THEN 'input_schema added' WHEN ni IS NULL THEN 'input_schema removed' ELSE 'input_schema changed' END FROM pairs WHERE oname IS NOT NULL AND nname IS NOT NULL AND oi IS DISTINCT FROM ni)"""


@register("d1_snapshot_changed", f"WITH {CHANGES_SQL}, c AS (SELECT server FROM changes UNION SELECT server FROM pairs WHERE odep IS DISTINCT FROM ndep) SELECT DISTINCT pairs.server, c.server IS NOT NULL AS changed FROM pairs LEFT JOIN c ON c.server = pairs.server")
def d1_snapshot_changed(spark, sf_dir):
    return drift.snapshot_changed(*snapshots(spark, sf_dir))


@register("d2_snapshot_changes", f"WITH {CHANGES_SQL} SELECT * FROM changes")
def d2_snapshot_changes(spark, sf_dir):
    return drift.snapshot_changes(*snapshots(spark, sf_dir))


@register("d3_change_rollup", f"WITH {CHANGES_SQL}, r AS (SELECT server, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'modified') AS modified FROM changes GROUP BY server) SELECT *, added + removed + modified AS total, concat_ws(',', CASE WHEN added > 0 THEN 'added' END, CASE WHEN removed > 0 THEN 'removed' END, CASE WHEN modified > 0 THEN 'modified' END) AS change_types FROM r")
def d3_change_rollup(spark, sf_dir):
    return drift.change_rollup(drift.snapshot_changes(*snapshots(spark, sf_dir))).withColumn("change_types", F.array_join("change_types", ","))


NORMAL_URL_SQL = "replace(replace(regexp_replace(lower(trim(url)), '/+$', ''), '127.0.0.1', 'localhost'), '0.0.0.0', 'localhost')"
KEY_SQL = f"CASE WHEN url IS NOT NULL THEN 'http:' || {NORMAL_URL_SQL} ELSE 'stdio:' || coalesce(name, '') || ':' || coalesce(command, '') || ':' || coalesce(array_to_string(args, ','), '') END"


def baseline(spark, sf_dir):
    """The state of the definitions before: two thirds of them, some with other names or variables."""
    keyed = cfg.dedup_key(v.configs(spark, sf_dir)).where("server_id % 3 <> 0")
    before = keyed.withColumn("env", F.when(F.col("server_id") % 4 == 1, F.lit(None)).otherwise(F.col("env"))).withColumn("name", F.when((F.col("server_id") % 5 == 2) & F.col("url").isNotNull(), "renamed").otherwise(F.col("name")))
    return before.groupBy("dedup_key").agg(F.min_by(F.struct("name", "url", "command", "args", "env"), "server_id").alias("c")).select("dedup_key", "c.*").withColumn("fingerprint", drift.fingerprint()).select("dedup_key", "fingerprint")


FP_SQL = "md5(concat_ws(chr(1), coalesce(name, '-'), coalesce(url, '-'), coalesce(command, '-'), coalesce(array_to_string(args, chr(2)), '-'), coalesce(env_text, '-')))"
DRIFT_SQL = f"""{CONFIGS_SQL}, keyed AS (SELECT *, {KEY_SQL} AS dedup_key FROM configs),
 prior AS (SELECT * REPLACE (CASE WHEN server_id % 4 = 1 THEN NULL ELSE env_text END AS env_text, CASE WHEN server_id % 5 = 2 AND url IS NOT NULL THEN 'renamed' ELSE name END AS name) FROM keyed WHERE server_id % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY server_id) = 1),
 base AS (SELECT dedup_key, {FP_SQL} AS fp FROM prior), now AS (SELECT server_id, dedup_key, {FP_SQL} AS fp FROM keyed)"""


@register("d4_config_drift", f"WITH {DRIFT_SQL} SELECT now.dedup_key, 'MCPConfigChanged' AS rule_name, 'HIGH' AS severity, 'supply-chain' AS category FROM now JOIN base USING (dedup_key) WHERE now.fp <> base.fp UNION ALL SELECT base.dedup_key, 'MCPConfigRemoved', 'HIGH', 'supply-chain' FROM base ANTI JOIN now USING (dedup_key)")
def d4_config_drift(spark, sf_dir):
    found = drift.config_drift(cfg.dedup_key(v.configs(spark, sf_dir)), baseline(spark, sf_dir), report_removed=True)
    return found.select("dedup_key", "rule_name", "severity", "category")


@register("d5_baseline_upsert", f"WITH {DRIFT_SQL} SELECT DISTINCT dedup_key, true AS known FROM base UNION ALL SELECT DISTINCT dedup_key, false FROM now ANTI JOIN base USING (dedup_key)")
def d5_baseline_upsert(spark, sf_dir):
    base = baseline(spark, sf_dir)
    after = drift.baseline_upsert(cfg.dedup_key(v.configs(spark, sf_dir)), base)
    same = base.select("dedup_key", F.col("fingerprint").alias("before"))
    return after.join(same, "dedup_key", "left").select("dedup_key", (F.col("fingerprint").eqNullSafe(F.col("before"))).alias("known"))


@register("d5_baseline_store", f"WITH {DRIFT_SQL}, v AS (SELECT DISTINCT dedup_key, 1 AS since FROM base UNION ALL SELECT DISTINCT dedup_key, 2 FROM now ANTI JOIN base USING (dedup_key)) SELECT dedup_key, since, 2 AS versions FROM v")
def d5_baseline_store(spark, sf_dir):
    """The baseline published, the definitions added as a second version, and both read again: the version from which each key is known."""
    store = BaselineStore(spark, shared_folder(spark, "baseline"))
    store.publish(baseline(spark, sf_dir), 0)
    store.upsert(cfg.dedup_key(v.configs(spark, sf_dir)))
    first = store.read(1).select("dedup_key", F.col("fingerprint").alias("before"))
    since = F.when(F.col("fingerprint").eqNullSafe(F.col("before")), 1).otherwise(2)
    return store.read().join(first, "dedup_key", "left").select("dedup_key", since.alias("since"), F.lit(store.version()).alias("versions"))


@register("d6_version_history", "WITH s AS (SELECT 'u' || (user_id % 40) AS url, ts, md5(event_type) AS version_hash FROM events), w AS (SELECT *, lag(version_hash) OVER o AS prev, row_number() OVER o AS rn FROM s WINDOW o AS (PARTITION BY url ORDER BY ts, version_hash)) SELECT url, count(*) AS n_snapshots, count(*) FILTER (rn = 1 OR prev <> version_hash) AS total_versions, arg_max(version_hash, rn) AS latest_hash, max(ts) AS last_updated FROM w GROUP BY url")
def d6_version_history(spark, sf_dir):
    events = v.table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("url"), "ts", F.md5("event_type").alias("version_hash"))
    return drift.version_history(events)


# ---- configurations ------------------------------------------------------------------------------------------------------

PATHS_EXPR = "'/x/' || CASE doc_id % 16 WHEN 0 THEN 'Claude/claude_desktop_config.json' WHEN 1 THEN '.claude/settings.json' WHEN 2 THEN 'Code/User/settings.json' WHEN 3 THEN 'p/.claude/settings.local.json' WHEN 4 THEN 'ClaudeCode/managed-settings.json' WHEN 5 THEN '.cursor/mcp.json' WHEN 6 THEN '.codeium/windsurf/m.json' WHEN 7 THEN 'gemini/s.json' WHEN 8 THEN 'zed/settings.json' WHEN 9 THEN 'nvim/a.lua' WHEN 10 THEN 'cursor-nightly/m.json' WHEN 11 THEN 'Microsoft VS Code/m.json' WHEN 12 THEN 'ext/rooveterinaryinc.cursor-mcp/m.json' WHEN 13 THEN 'settings.json' WHEN 14 THEN 'helix/zencoder/x' ELSE 'nothing/here.json' END"
CLIENT_SQL = "CASE doc_id % 16 WHEN 0 THEN 'claude' WHEN 1 THEN 'claude-code' WHEN 2 THEN 'vscode' WHEN 3 THEN 'claude-code' WHEN 4 THEN 'claude-code' WHEN 5 THEN 'cursor' WHEN 6 THEN 'windsurf' WHEN 7 THEN 'gemini' WHEN 8 THEN 'zed' WHEN 9 THEN 'neovim' WHEN 10 THEN 'cursor' WHEN 11 THEN 'vscode' WHEN 12 THEN 'cursor' WHEN 14 THEN 'helix' END"


@register("c1_detect_client", f"SELECT doc_id, {PATHS_EXPR} AS path, {CLIENT_SQL} AS client FROM documents")
def c1_detect_client(spark, sf_dir):
    return v.table(spark, sf_dir, "documents").selectExpr("doc_id", f"{PATHS_EXPR} AS path").withColumn("client", cfg.detect_client(F.col("path")))


@register("c2_dedup_key", f"WITH {CONFIGS_SQL} SELECT server_id, {KEY_SQL} AS dedup_key FROM configs")
def c2_dedup_key(spark, sf_dir):
    return cfg.dedup_key(v.configs(spark, sf_dir)).select("server_id", "dedup_key")


@register("c3_merge_configs", f"WITH {CONFIGS_SQL}, keyed AS (SELECT *, {KEY_SQL} AS dedup_key FROM configs), best AS (SELECT dedup_key, server_id FROM keyed QUALIFY row_number() OVER (PARTITION BY dedup_key ORDER BY precedence DESC, server_id DESC) = 1), opts AS (SELECT dedup_key, arg_max(timeout, precedence * 1000000 + server_id) FILTER (timeout IS NOT NULL) AS timeout, arg_max(format, precedence * 1000000 + server_id) FILTER (format IS NOT NULL) AS format FROM keyed GROUP BY dedup_key), heads AS (SELECT dedup_key, count(DISTINCT header_name) AS n_headers FROM keyed WHERE header_name IS NOT NULL GROUP BY dedup_key) SELECT dedup_key, server_id, opts.timeout, opts.format, coalesce(n_headers, 0) AS n_headers FROM best JOIN opts USING (dedup_key) LEFT JOIN heads USING (dedup_key)")
def c3_merge_configs(spark, sf_dir):
    keyed = cfg.dedup_key(v.configs(spark, sf_dir))
    best = cfg.merge_configs(keyed).select("dedup_key", "server_id")
    options = cfg.merge_options(keyed, "dedup_key", ("timeout", "format"))
    heads = cfg.merge_headers(keyed, "dedup_key").groupBy("dedup_key").agg(F.count("*").alias("n_headers"))
    return best.join(options, "dedup_key").join(heads, "dedup_key", "left").withColumn("n_headers", F.coalesce("n_headers", F.lit(0)))


def rule_sql(rule: str, bad: str, detail: str = "''") -> str:
    return f"SELECT file, server_id, '{rule}' AS rule, CAST({detail} AS VARCHAR) AS detail FROM rows_ WHERE {bad}"


VIOLATIONS_SQL = f"""{CONFIGS_SQL}, keyed AS (SELECT *, {KEY_SQL} AS dedup_key, trim(name) AS tname FROM configs),
 rows_ AS (SELECT *, count(*) OVER (PARTITION BY file) AS n_servers, row_number() OVER (PARTITION BY file, dedup_key ORDER BY server_id) AS key_place, row_number() OVER (PARTITION BY file, tname ORDER BY server_id) AS name_place FROM keyed),
 vars AS (SELECT file, server_id, unnest(env).k AS k FROM rows_),
 violations AS (""" + " UNION ALL ".join([
    rule_sql("url_and_command", "url IS NOT NULL AND command IS NOT NULL"),
    rule_sql("no_url_or_command", "url IS NULL AND command IS NULL"),
    rule_sql("empty_command", "url IS NULL AND trim(command) = ''"),
    rule_sql("stdio_url", "command IS NULL AND starts_with(trim(url), 'stdio:')", "trim(url)"),
    rule_sql("url_scheme", "command IS NULL AND url <> '' AND NOT regexp_matches(trim(url), '^https?://') AND NOT starts_with(trim(url), 'stdio:')", "trim(url)"),
    rule_sql("port_zero", "command IS NULL AND regexp_matches(trim(url), '^https?://[^/]*:0+(/|$)')", "trim(url)"),
    rule_sql("empty_name", "trim(name) = ''"),
    rule_sql("many_servers", "n_servers > 100", "n_servers"),
    rule_sql("duplicate_key", "key_place > 1", "dedup_key"),
    rule_sql("duplicate_name", "tname IS NOT NULL AND name_place > 1", "tname"),
    rule_sql("empty_header_value", "header_name IS NOT NULL AND trim(header_value) = ''", "header_value"),
    "SELECT file, server_id, 'variable_digit', k FROM vars WHERE regexp_matches(k, '^[0-9]')",
]) + ")"


@register("c4_validate_configs", f"WITH {VIOLATIONS_SQL} SELECT * FROM violations")
def c4_validate_configs(spark, sf_dir):
    return cfg.validate_configs(v.configs(spark, sf_dir))


@register("c5_drop_invalid", f"WITH {VIOLATIONS_SQL}, bad AS (SELECT DISTINCT file, server_id FROM violations) SELECT 'server' AS scope, configs.server_id FROM configs ANTI JOIN bad ON configs.file = bad.file AND configs.server_id = bad.server_id UNION ALL SELECT 'file', configs.server_id FROM configs ANTI JOIN bad ON configs.file = bad.file")
def c5_drop_invalid(spark, sf_dir):
    rows = v.configs(spark, sf_dir)
    bad = cfg.validate_configs(rows)
    one = lambda s: cfg.drop_invalid(rows, bad, s).select(F.lit(s).alias("scope"), "server_id")
    return one("server").unionByName(one("file"))


@register("c6_sources", f"WITH {CONFIGS_SQL} SELECT server_id, CASE WHEN contains(description, '[IDE:') THEN regexp_extract(description, '^.*\\[IDE:([^\\]]*)\\]', 1) ELSE 'IDE Configs' END AS before, concat_ws(' ', description, '[IDE:tagged]') AS description, 'tagged' AS after FROM configs")
def c6_sources(spark, sf_dir):
    rows = v.configs(spark, sf_dir).withColumn("before", cfg.source_of(F.col("description")))
    return cfg.tag_source(rows, F.lit("tagged")).select("server_id", "before", "description", cfg.source_of(F.col("description")).alias("after"))


@register("c7_effective_options", f"WITH {CONFIGS_SQL}, o AS (SELECT server_id, coalesce(timeout, 60) AS t, coalesce(http_timeout, 30) AS h, coalesce(format, 'table') AS f, header_name, header_value FROM configs) SELECT server_id, t AS effective_timeout, h AS effective_http_timeout, f AS effective_format, t > 0 AND h > 0 AND t >= h AND t <= 3600 AND h <= 3600 AS valid, coalesce(CASE WHEN header_name = 'X-Key' THEN header_value END, 'global') AS x_key FROM o")
def c7_effective_options(spark, sf_dir):
    rows = v.configs(spark, sf_dir)
    got = cfg.effective_options(rows, {"timeout": 60, "format": "table"}, {"timeout": 5, "http_timeout": 30, "format": "raw"})
    heads = cfg.effective_headers(rows, {"X-Key": "global"}, {"X-Key": "request", "A": "b"}).where("header_name = 'X-Key'").select("server_id", F.col("header_value").alias("x_key"))
    return got.join(heads, "server_id").select("server_id", "effective_timeout", "effective_http_timeout", "effective_format", "valid", "x_key")
