"""Registered queries of the sources, sinks and stateful operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditgrove.functions.storage import shared_folder
from auditgrove.operators import catalog, items, rules
from auditgrove.operators.configs import dedup_key
from auditgrove.plans import views as v
from auditgrove.plans.result_queries import EVERY_SQL, every
from auditgrove.plans.rule_queries import ITEMS_SQL, MATCH_SQL, SEVERITY_SQL, all_items, quote
from auditgrove.sources import readers, writers
from auditgrove.sources.baselines import BaselineStore
from auditgrove.streaming import scan, state

QUERIES, ORACLE = {}, {}


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return keep


@register("s1_manifests", f"WITH {v.TOOLS_SQL} SELECT server, name, coalesce(input_schema, '-') AS input_schema, md5(description) AS description_md5, NULL AS error FROM tools WHERE doc_id % 50 <> 7 UNION ALL SELECT server, NULL, '-', NULL, 'no tools array' FROM tools WHERE doc_id % 50 = 7")
def s1_manifests(spark, sf_dir):
    """List replies built from the tools, a reply each; some lack their array."""
    tools = v.tools(spark, sf_dir)
    quoted = F.to_json(F.array("description"))  # the whole text, escaped, in brackets
    body = F.concat(F.lit('{"result":{"tools":[{"name":"'), "name", F.lit('","inputSchema":'), F.coalesce("input_schema", F.lit("null")), F.lit(',"description":'), F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit("}]}}"))
    replies = tools.select("server", F.when(F.col("doc_id") % 50 == 7, '{"error":{"code":1}}').otherwise(body).alias("content"))
    got = readers.manifest_items(replies, "tools")
    return got.select("server", "name", F.coalesce("input_schema", F.lit("-")).alias("input_schema"), F.md5("description").alias("description_md5"), "error")


FILES_EXPR = """CASE s_suppkey % 8
 WHEN 0 THEN '{"mcpServers":{"' || s_name || '":{"command":"npx","args":["-y","p' || s_suppkey || '"],"env":{"A":"b"}},"off":{"command":"x","disabled":true}}}'
 WHEN 1 THEN '{"mcpServers":{"' || s_name || '":{"url":"https://h' || s_suppkey || '.example/","command":"ignored","headers":{"K":"v"}}}}'
 WHEN 2 THEN '{"mcpServers":{"' || s_name || '":{"transport":{"host":"h' || s_suppkey || '"}}}}'
 WHEN 3 THEN '{"mcp.servers":{"' || s_name || '":{"command":"uvx"}}}'
 WHEN 4 THEN '{"servers":{"' || s_name || '":{"url":"http://s' || s_suppkey || '"},"empty":{"description":"nothing"}}}'
 WHEN 5 THEN '{"servers":[{"name":"' || s_name || '","url":"http://a' || s_suppkey || '"},{"name":"two","command":"sh","args":["-c"]}]}'
 WHEN 6 THEN '{"context_servers":[{"' || s_name || '":{"command":{"path":"zedcmd","args":["q"]}}}]}'
 ELSE '{"command":"zen","args":["1","2"],"env":{}}' END"""


@register("s2_client_configs", """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 8 AS m, s_name AS n FROM supplier)
SELECT k, n AS name, NULL AS url, 'npx' AS command, '-y,p' || k AS args, 'named' AS format FROM f WHERE m = 0
UNION ALL SELECT k, n, 'https://h' || k || '.example/', NULL, '', 'named' FROM f WHERE m = 1
UNION ALL SELECT k, n, 'http://h' || k || ':8080', NULL, '', 'named' FROM f WHERE m = 2
UNION ALL SELECT k, n, NULL, 'uvx', '', 'named' FROM f WHERE m = 3
UNION ALL SELECT k, n, 'http://s' || k, NULL, '', 'map' FROM f WHERE m = 4
UNION ALL SELECT k, n, 'http://a' || k, NULL, '', 'array' FROM f WHERE m = 5
UNION ALL SELECT k, 'two', NULL, 'sh', '-c', 'array' FROM f WHERE m = 5
UNION ALL SELECT k, n, NULL, 'zedcmd', 'q', 'nested' FROM f WHERE m = 6
UNION ALL SELECT k, 'zencoder', NULL, 'zen', '1,2', 'single' FROM f WHERE m = 7""")
def s2_client_configs(spark, sf_dir):
    files = v.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS file", f"{FILES_EXPR} AS content")
    got = readers.client_servers(files)
    return got.select(F.col("file").alias("k"), "name", "url", "command", F.coalesce(F.array_join("args", ","), F.lit("")).alias("args"), "format")


#: Command objects with other keys, key orders and brackets inside, file and server options, and a file that is no JSON.
TYPED_EXPR = """CASE s_suppkey % 7
 WHEN 0 THEN '{"context_servers":[{"' || s_name || '":{"command":{"args":["a]b","' || s_suppkey || '"],"env":{"K":"v"},"path":"zed cmd"},"env":{"E":"1"}}}]}'
 WHEN 1 THEN '{"context_servers":[{"' || s_name || '":{"command":{"path":"p","settings":{"args":["no"]}}}},{"second":{"command":"plain"}}]}'
 WHEN 2 THEN '{"global":{"timeout":' || s_suppkey || ',"format":"json","detailed":true},"servers":{"' || s_name || '":{"command":"ws","options":{"timeout":5}},"other":{"url":"http://o"}}}'
 WHEN 3 THEN '{"servers":[{"name":"' || s_name || '","url":"http://a"}],"options":{"http_timeout":' || (s_suppkey % 90) || '}}'
 WHEN 4 THEN '{"mcpServers":{"' || s_name || '":{"command":{"path":"obj","args":[]}}}}'
 WHEN 5 THEN '{"command":"zen","args":["{' || char(92) || '"path' || char(92) || '":1}"]}'
 ELSE 'not json' END"""


@register("s2_typed_layouts", """WITH f AS (SELECT s_suppkey AS k, s_suppkey % 7 AS m, s_name AS n FROM supplier)
SELECT k, n AS name, NULL AS url, 'zed cmd' AS command, 'a]b|' || k AS args, 'nested' AS format, 'Command: zed cmd a]b ' || k AS description, NULL::BIGINT AS timeout, NULL::BIGINT AS http_timeout, NULL AS output_format, NULL::BOOLEAN AS detailed FROM f WHERE m = 0
UNION ALL SELECT k, n, NULL, 'p', '', 'nested', 'Command: p ', NULL, NULL, NULL, NULL FROM f WHERE m = 1
UNION ALL SELECT k, 'second', NULL, 'plain', '', 'nested', NULL, NULL, NULL, NULL, NULL FROM f WHERE m = 1
UNION ALL SELECT k, n, NULL, 'ws', '', 'map', NULL, 5, NULL, 'json', true FROM f WHERE m = 2
UNION ALL SELECT k, 'other', 'http://o', NULL, '', 'map', NULL, k, NULL, 'json', true FROM f WHERE m = 2
UNION ALL SELECT k, n, 'http://a', NULL, '', 'array', NULL, NULL, k % 90, NULL, NULL FROM f WHERE m = 3
UNION ALL SELECT k, n, NULL, 'obj', '', 'named', 'Command: obj ', NULL, NULL, NULL, NULL FROM f WHERE m = 4
UNION ALL SELECT k, 'zencoder', NULL, 'zen', '{"path":1}', 'single', 'Zencoder MCP server', NULL, NULL, NULL, NULL FROM f WHERE m = 5""")
def s2_typed_layouts(spark, sf_dir):
    got = readers.client_servers(v.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS file", f"{TYPED_EXPR} AS content"))
    return got.select(F.col("file").alias("k"), "name", "url", "command", F.coalesce(F.array_join("args", "|"), F.lit("")).alias("args"), "format", "description", "timeout", "http_timeout", "output_format", "detailed")


@register("s3_snapshots", "SELECT 'https://u' || user_id AS url, ts, CASE WHEN event_id % 3 = 0 THEN sha256('') WHEN event_id % 3 = 1 THEN 'h' || event_id ELSE sha256('[{\"name\":\"t' || event_id || '\"}]') END AS version_hash, CASE WHEN event_id % 3 = 2 THEN 1 ELSE 0 END AS tool_count FROM events")
def s3_snapshots(spark, sf_dir):
    id_ = F.col("event_id").cast("string")
    tools = F.when(F.col("event_id") % 3 == 2, F.concat(F.lit('[{"name":"t'), id_, F.lit('"}]'))).otherwise("[]")
    stored = F.when(F.col("event_id") % 3 == 1, F.concat(F.lit(',"version_hash":"h'), id_, F.lit('"'))).otherwise("")
    content = F.concat(F.lit('{"url":"https://u'), F.col("user_id").cast("string"), F.lit('","snapshots":[{"timestamp":"'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('Z","tools":'), tools, stored, F.lit("}]}"))
    return readers.snapshot_rows(v.table(spark, sf_dir, "events").select(content.alias("content"))).select("url", "ts", "version_hash", "tool_count")


#: A rule of a user, and three that cannot be used.
ADDED = catalog.Catalog(
    {"LongNumber": ("own_rules", "pre", "Long number", "1", "A number of six digits or more", "LOW", "numbers", None), "Orphan": ("own_rules", "pre", "Orphan", "1", "", "LOW", "x", None), "Broken": ("own_rules", "pre", "Broken", "1", "", "LOW", "x", None), "Empty": ("own_rules", "post", "Empty", "1", "", "LOW", "x", None)},
    {"LongNumber": {"digits": (r"\b[0-9]{6,}\b", False)}, "Orphan": {"p": ("x", False)}, "Broken": {"p": ("(unclosed", False)}, "Empty": {"p": ("x", False)}},
    {"LongNumber": ("any", "digits"), "Orphan": ("any", "p", "q"), "Broken": ("any", "p")},
    {},
)


@register("s4_loaded_catalog", f"""WITH {MATCH_SQL} SELECT 'match' AS kind, item_id, rule_name, NULL AS problem FROM matches WHERE target_type = 'prompt'
 UNION ALL SELECT 'match', item_id, 'LongNumber', NULL FROM items WHERE item_type = 'prompt' AND regexp_matches(full_text, {quote(ADDED.patterns['LongNumber']['digits'][0])})
 UNION ALL SELECT 'problem', NULL, r, p FROM (VALUES ('Orphan', 'unknown pattern q'), ('Broken', 'pattern p does not compile'), ('Empty', 'no condition')) x(r, p)""")
def s4_loaded_catalog(spark, sf_dir):
    """The catalog and four more rules written as files, read again, and run on all prompts."""
    folder = shared_folder(spark, "catalog")
    both = catalog.Catalog(*[dict(a) | dict(b) for a, b in zip(catalog.BUILT_IN, ADDED)])
    catalog.write_catalog(spark, both, folder)
    loaded, problems = catalog.read_catalog(spark, folder)
    found = rules.rule_matches(items.to_items(prompts=v.prompts(spark, sf_dir)), catalog=loaded)
    none = F.lit(None).cast("string")
    return found.select(F.lit("match").alias("kind"), "item_id", "rule_name", none.alias("problem")).unionByName(problems.select(F.lit("problem").alias("kind"), none.alias("item_id"), F.col("rule").alias("rule_name"), "problem"))


@register("s5_stored_findings", f"WITH {MATCH_SQL} SELECT server, item_id, rule_name, {SEVERITY_SQL} AS severity, '2026-01-02' AS scan_date FROM matches")
def s5_stored_findings(spark, sf_dir):
    """All findings written by date and read again."""
    folder = shared_folder(spark, "findings")
    writers.write_findings(rules.annotate_findings(rules.rule_matches(all_items(spark, sf_dir))), folder, "2026-01-02")
    return spark.read.parquet(folder).select("server", "item_id", "rule_name", "severity", F.col("scan_date").cast("string").alias("scan_date"))


@register("r6_catalog_stats")
def r6_catalog_stats(spark, sf_dir):
    """Catalog statistics next to what the corpus makes of each rule."""
    stats = rules.catalog_stats(*catalog.rule_catalog(spark)).select("phase", "n_rules", "n_patterns")
    seen = rules.rule_matches(all_items(spark, sf_dir)).groupBy("phase", "rule_name").agg(F.count("*").alias("n_items"))
    return seen.join(stats, "phase")


ORACLE["r6_catalog_stats"] = f"WITH {MATCH_SQL} SELECT 'pre' AS phase, rule_name, count(*) AS n_items, {len(catalog.RULES)} AS n_rules, {sum(map(len, catalog.PATTERNS.values()))} AS n_patterns FROM matches GROUP BY rule_name"


@register("s6_nested_results", f"WITH {EVERY_SQL}, i AS (SELECT server, count(*) AS items FROM items GROUP BY server), f AS (SELECT server, count(*) AS findings FROM every JOIN (SELECT DISTINCT item_id, server AS s FROM items) USING (item_id) GROUP BY server) SELECT server, items, coalesce(findings, 0) AS findings FROM i LEFT JOIN f USING (server)")
def s6_nested_results(spark, sf_dir):
    documents = writers.nested_results(all_items(spark, sf_dir), every(spark, sf_dir))
    parsed = F.from_json("document", "struct<server string, summary struct<total_issues long>, items array<struct<item_id string>>>")
    return documents.select(parsed.alias("d")).select("d.server", F.size("d.items").cast("long").alias("items"), F.col("d.summary.total_issues").alias("findings"))


@register("s6_document_lines", f"WITH {EVERY_SQL}, i AS (SELECT server, count(*) AS items FROM items GROUP BY server), f AS (SELECT server, count(*) AS findings FROM every JOIN (SELECT DISTINCT item_id, server AS s FROM items) USING (item_id) GROUP BY server) SELECT server, items, coalesce(findings, 0) AS findings, true AS valid FROM i LEFT JOIN f USING (server)")
def s6_document_lines(spark, sf_dir):
    """Documents written line by line over many files; put together again per server they are valid JSON."""
    lines = writers.nested_lines(all_items(spark, sf_dir), every(spark, sf_dir))
    whole = lines.groupBy("server").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "item_type", "item_id", "line"))), lambda r: r["line"]), "\n").alias("document"))
    parsed = F.from_json("document", "struct<server string, summary struct<total_issues long>, items array<struct<item_id string>>>")
    return whole.select("server", parsed.alias("d"), F.try_parse_json("document").isNotNull().alias("valid")).select("server", F.size("d.items").cast("long").alias("items"), F.col("d.summary.total_issues").alias("findings"), "valid")


@register("s6_wrapped_document", f"WITH {EVERY_SQL}, i AS (SELECT server, count(*) AS items FROM items GROUP BY server) SELECT server, items, (SELECT count(*) FROM i) AS total_servers FROM i")
def s6_wrapped_document(spark, sf_dir):
    """One document over all servers, written as text and read again line by line."""
    folder = shared_folder(spark, "wrapped")
    writers.write_wrapped(all_items(spark, sf_dir), every(spark, sf_dir), folder)
    lines = spark.read.text(folder)
    total = lines.where("value like '{\"scan_type\"%'").select(F.get_json_object(F.concat("value", F.lit("]}")), "$.total_servers").cast("long").alias("total_servers"))
    parsed = F.from_json(F.regexp_replace("value", "^,", ""), "struct<server string, items array<struct<item_id string>>>")
    documents = lines.where("value rlike '^,?[{]\"server\"'").select(parsed.alias("d")).select("d.server", F.size("d.items").cast("long").alias("items"))
    return documents.crossJoin(F.broadcast(total))  # the head line


RATE_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT url, rn, event_id, [us] AS log, true AS allowed FROM e WHERE rn = 1
  UNION ALL SELECT e.url, e.rn, e.event_id, CASE WHEN len(list_filter(f.log, lambda t: e.us - t < 21600000000)) >= 3 THEN list_filter(f.log, lambda t: e.us - t < 21600000000) ELSE list_append(list_filter(f.log, lambda t: e.us - t < 21600000000), e.us) END, len(list_filter(f.log, lambda t: e.us - t < 21600000000)) < 3 FROM f JOIN e ON e.url = f.url AND e.rn = f.rn + 1)
SELECT url, event_id, allowed FROM f"""


def requests(spark, sf_dir):
    return v.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("url"), "event_id", "ts")


@register("t1_rate_limit", RATE_SQL)
def t1_rate_limit(spark, sf_dir):
    return state.rate_limit(requests(spark, sf_dir), limit=3, window_seconds=6 * 3600).select("url", "event_id", "allowed")


CACHE_SQL = """WITH RECURSIVE e AS (SELECT CAST(user_id AS VARCHAR) AS url, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
 f AS (SELECT url, rn, event_id, us AS stored, false AS hit FROM e WHERE rn = 1
  UNION ALL SELECT e.url, e.rn, e.event_id, CASE WHEN e.us <= f.stored + 43200000000 THEN f.stored ELSE e.us END, e.us <= f.stored + 43200000000 FROM f JOIN e ON e.url = f.url AND e.rn = f.rn + 1)
SELECT url, event_id, hit FROM f"""


@register("t2_ttl_cache", CACHE_SQL)
def t2_ttl_cache(spark, sf_dir):
    return state.ttl_cache(requests(spark, sf_dir), ttl_seconds=12 * 3600).select("url", "event_id", "hit")


@register("t2_cache_stats", f"WITH x AS ({CACHE_SQL.replace('SELECT url, event_id, hit FROM f', 'SELECT url, max(stored) AS stored FROM f GROUP BY url').replace('WITH RECURSIVE ', 'WITH RECURSIVE ', 1)}), m AS (SELECT max(epoch_us(ts)) AS us FROM events) SELECT count(*) AS total, count(*) FILTER (us <= stored + 43200000000) AS active, count(*) FILTER (us > stored + 43200000000) AS expired FROM x, m")
def t2_cache_stats(spark, sf_dir):
    """Entries alive and expired at the time of the last lookup."""
    last = v.table(spark, sf_dir, "events").agg(F.max("ts").alias("ts")).first()["ts"]
    return state.cache_stats(state.ttl_cache(requests(spark, sf_dir), ttl_seconds=12 * 3600), last, ttl_seconds=12 * 3600).drop("tools")


TOOLED_SQL = CACHE_SQL.replace("epoch_us(ts) AS us,", "epoch_us(ts) AS us, event_id % 5 AS offered,").replace("us AS stored, false AS hit", "us AS stored, offered AS tools, false AS hit").replace(" ELSE e.us END, e.us <=", " ELSE e.us END, CASE WHEN e.us <= f.stored + 43200000000 THEN f.tools ELSE e.offered END, e.us <=")


@register("t2_cached_tools", f"WITH x AS ({TOOLED_SQL.replace('SELECT url, event_id, hit FROM f', 'SELECT url, max(stored) AS stored, arg_max(tools, stored) AS tools FROM f GROUP BY url')}), m AS (SELECT max(epoch_us(ts)) AS us FROM events) SELECT count(*) AS total, count(*) FILTER (us <= stored + 43200000000) AS active, count(*) FILTER (us > stored + 43200000000) AS expired, sum(tools)::BIGINT AS tools FROM x, m")
def t2_cached_tools(spark, sf_dir):
    """Statistics of a cache whose entries say how many tools they hold, at the time of the last lookup."""
    events = v.table(spark, sf_dir, "events")
    last = events.agg(F.max("ts").alias("ts")).first()["ts"]
    lookups = requests(spark, sf_dir).withColumn("tools", F.col("event_id") % 5)
    return state.cache_stats(state.ttl_cache(lookups, ttl_seconds=12 * 3600), last, ttl_seconds=12 * 3600)


TIMED_SQL = f"{MATCH_SQL}, timed AS (SELECT *, {SEVERITY_SQL} AS severity, TIMESTAMP '2026-01-01' + to_minutes(CAST(7 * length(item_id) + ascii(substr(item_id, length(item_id))) AS BIGINT)) AS ts FROM matches)"


@register("t3_severity_windows", f"WITH {TIMED_SQL} SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, server, severity, count(*) AS n FROM timed GROUP BY ALL")
def t3_severity_windows(spark, sf_dir):
    minutes = 7 * F.length("item_id") + F.ascii(F.substring("item_id", -1, 1))
    timed = all_items(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp")) + minutes * 60))
    return scan.severity_windows(scan.stream_scan(timed)).select("window_start", "server", "severity", "n")


DRIFT_KEYS_SQL = "SELECT 'http:http://u' || (user_id % 50) AS dedup_key, ts, CASE WHEN event_type = 'click' THEN 'a' ELSE event_type END AS d FROM events"


@register("t4_drift_events", f"WITH k AS ({DRIFT_KEYS_SQL}), b AS (SELECT dedup_key, ts, d, first_value(d) OVER (PARTITION BY dedup_key ORDER BY ts) AS base FROM k) SELECT dedup_key, ts FROM b WHERE d <> base")
def t4_drift_events(spark, sf_dir):
    return scan.batch_drift(dedup_key(definitions(spark, sf_dir))).select("dedup_key", "ts")


def definitions(spark, sf_dir):
    events = v.table(spark, sf_dir, "events")
    return events.select(F.concat(F.lit("http://u"), (F.col("user_id") % 50).cast("string")).alias("url"), "ts", F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.lit(None).cast("map<string,string>").alias("env"), F.when(F.col("event_type") == "click", "a").otherwise(F.col("event_type")).alias("name"))


@register("t4_from_baseline", f"WITH k AS ({DRIFT_KEYS_SQL}), s AS (SELECT dedup_key, min(d) AS base FROM k WHERE CAST(substr(dedup_key, 14) AS INT) % 2 = 0 GROUP BY dedup_key), b AS (SELECT k.*, coalesce(s.base, first_value(d) OVER (PARTITION BY k.dedup_key ORDER BY ts)) AS base FROM k LEFT JOIN s ON s.dedup_key = k.dedup_key) SELECT dedup_key, ts FROM b WHERE d <> base")
def t4_from_baseline(spark, sf_dir):
    """Drift from a stored baseline that knows half of the keys; the others start with their first definition."""
    configs = definitions(spark, sf_dir)
    known = configs.where("cast(substr(url, 9) as int) % 2 = 0").groupBy("url").agg(F.min("name").alias("name"))
    known = known.select("url", "name", F.lit(None).cast("string").alias("command"), F.lit(None).cast("array<string>").alias("args"), F.lit(None).cast("map<string,string>").alias("env"))
    store = BaselineStore(spark, shared_folder(spark, "drift"))
    store.upsert(dedup_key(known))
    return scan.batch_drift(dedup_key(configs), store.read()).select("dedup_key", "ts")
