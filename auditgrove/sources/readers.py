"""Sources: manifest dumps, client configuration files and snapshot histories as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTS = {"tools": "tools", "resources": "resources", "prompts": "prompts"}
SERVER = "struct<url string, command variant, args array<string>, env map<string,string>, description string, headers map<string,string>, auth_headers map<string,string>, transport struct<type string, scheme string, host string, port int>, disabled boolean, name string, options struct<timeout long, http_timeout long, format string, detailed boolean>>"
#: Options of a whole file, which hold where a server says nothing of its own.
GLOBAL = "struct<timeout long, http_timeout long, format string, detailed boolean>"
COLUMNS = ["file", "name", "url", "command", "args", "env", "description", "auth_headers", "format", "timeout", "http_timeout", "output_format", "detailed"]


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file and content; each file is one row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def manifest_items(replies: DataFrame, kind: str) -> DataFrame:
    """Items of JSON-RPC list replies (columns ``server``, ``content``), a row each; a reply without its array gives an error row.

    The whole element is kept in ``raw_json``; a missing name is ``unknown``, a missing URI empty.
    """
    content = F.col("content")
    listed = F.coalesce(F.get_json_object(content, f"$.result.{LISTS[kind]}"), F.get_json_object(content, f"$.{LISTS[kind]}"))
    elements = F.from_json(listed, "array<string>")
    rows = replies.select("server", elements.alias("elements"), content)
    good = rows.where("elements is not null").select("server", F.posexplode("elements").alias("place", "raw_json"))
    value = lambda k: F.get_json_object("raw_json", f"$.{k}")
    items = good.select(
        "server", F.lit(kind[:-1]).alias("item_type"), F.col("place").cast("long").alias("place"), F.coalesce(value("name"), F.lit("unknown")).alias("name"), F.coalesce(value("uri"), F.lit("")).alias("uri"),
        value("description").alias("description"), F.coalesce(value("inputSchema"), value("input_schema")).alias("input_schema"), value("outputSchema").alias("output_schema"), value("mimeType").alias("mime_type"),
        value("size").cast("decimal(20,0)").alias("size"), value("arguments").alias("arguments"), "raw_json", F.lit(None).cast("string").alias("error"),
    )
    bad = rows.where("elements is null").select("server", F.lit(kind[:-1]).alias("item_type"), F.concat(F.lit("no "), F.lit(kind), F.lit(" array")).alias("error"))
    return items.unionByName(bad, allowMissingColumns=True)


def read_manifests(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """S1 on files; the server is the file."""
    return manifest_items(whole_files(spark, path).withColumnRenamed("file", "server"), kind)


def client_servers(files: DataFrame) -> DataFrame:
    """One row per server of every configuration file (columns ``file``, ``content``), whatever its layout.

    Layouts are told by their keys: ``mcpServers``, ``mcp.servers``, ``servers`` (map or array), ``context_servers`` or a single server.
    A command is a string, or an object with ``path`` and ``args`` in any order and beside any other keys; the object's own arguments come first. An empty
    ``mcpServers`` leaves room for none of the others. A transport gives a URL with localhost, 8080 and http as defaults; servers with neither URL
    nor command, and disabled ones, are left out. ``timeout``, ``http_timeout``, ``output_format`` and ``detailed`` are a server's
    ``options``, and where it has none the file's ``options`` or ``global``. A file that is no JSON object has no server.
    """
    part = lambda *path: F.coalesce(*[F.get_json_object("content", p) for p in path])
    named, listed, zed, single = part("$.mcpServers", "$['mcp.servers']"), part("$.servers"), part("$.context_servers"), part("$.command")
    is_array = F.startswith(F.ltrim(listed), F.lit("["))
    as_map = f"map<string,{SERVER}>"
    entries = lambda c: F.map_entries(F.from_json(c, as_map))
    none = F.array().cast(f"array<struct<key:string,value:{SERVER}>>")
    own = f"struct<key:string,value:{SERVER}>"
    zed_rows = F.flatten(F.filter(F.transform(F.from_json(zed, f"array<map<string,{SERVER}>>"), lambda m: F.map_entries(m)), lambda e: e.isNotNull()))
    servers = (
        F.when(named.isNotNull(), entries(named)).when(listed.isNotNull() & ~is_array, entries(listed))
        .when(listed.isNotNull(), F.transform(F.from_json(listed, f"array<{SERVER}>"), lambda s: F.struct(s["name"].alias("key"), s.alias("value")).cast(own)))
        .when(zed.isNotNull(), zed_rows)
        .when(single.isNotNull(), F.array(F.struct(F.lit("zencoder").alias("key"), F.from_json("content", SERVER).alias("value")).cast(own))).otherwise(none)
    )
    layout = F.when(named.isNotNull(), "named").when(listed.isNotNull() & ~is_array, "map").when(listed.isNotNull(), "array").when(zed.isNotNull(), "nested").when(single.isNotNull(), "single")
    shared = F.from_json(F.coalesce(part("$.options"), part("$.global")), GLOBAL)
    rows = files.select("file", layout.alias("format"), shared.alias("shared"), F.explode(servers).alias("s")).select("file", "format", "shared", F.col("s.key").alias("name"), "s.value")
    is_text = F.schema_of_variant("value.command") == "STRING"
    inner_path = F.try_variant_get("value.command", "$.path", "string")
    command = F.when(is_text, F.try_variant_get("value.command", "$", "string")).otherwise(inner_path)
    args = F.when(~is_text & inner_path.isNotNull(), F.coalesce(F.try_variant_get("value.command", "$.args", "array<string>"), F.col("value.args"))).otherwise(F.col("value.args"))
    spelt = F.concat(F.lit("Command: "), inner_path, F.lit(" "), F.coalesce(F.array_join(args, " "), F.lit("")))
    described = F.coalesce("value.description", F.when(~is_text & inner_path.isNotNull(), spelt), F.when(F.col("format") == "single", "Zencoder MCP server"))
    option = lambda k: F.coalesce(F.col(f"value.options.{k}"), F.col(f"shared.{k}"))
    t = F.col("value.transport")
    built = F.when(t.isNotNull() & t["type"].isNull() | t["host"].isNotNull() | t["port"].isNotNull(), F.concat(F.coalesce(t["scheme"], F.lit("http")), F.lit("://"), F.coalesce(t["host"], F.lit("localhost")), F.lit(":"), F.coalesce(t["port"], F.lit(8080)).cast("string")))
    url = F.coalesce("value.url", built)
    out = rows.where(~F.coalesce("value.disabled", F.lit(False))).select(
        "file", "name", url.alias("url"), F.when(url.isNull(), command).alias("command"), F.when(url.isNull(), args).alias("args"), F.when(url.isNull(), F.col("value.env")).alias("env"),
        described.alias("description"), F.coalesce("value.headers", "value.auth_headers").alias("auth_headers"), "format",
        option("timeout").alias("timeout"), option("http_timeout").alias("http_timeout"), option("format").alias("output_format"), option("detailed").alias("detailed"),
    )
    return out.where("url is not null or command is not null").select(*COLUMNS)


def read_client_configs(spark: SparkSession, path: str) -> DataFrame:
    """S2 on files."""
    return client_servers(whole_files(spark, path))


def snapshot_rows(files: DataFrame) -> DataFrame:
    """S3: a row per snapshot of version histories (column ``content``); the hash is SHA-256 over the tools where none is stored."""
    history = F.from_json("content", "struct<url string, last_updated string, snapshots array<struct<url string, tools string, timestamp string, version_hash string, tool_count long>>>")
    rows = files.select(history.alias("h")).select(F.col("h.url").alias("history_url"), F.explode("h.snapshots").alias("s"))
    tools = F.coalesce(F.col("s.tools"), F.lit("[]"))
    count = F.coalesce(F.col("s.tool_count"), F.json_array_length(tools).cast("long"))
    return rows.select(F.coalesce("s.url", "history_url").alias("url"), F.try_to_timestamp("s.timestamp").alias("ts"), F.coalesce("s.version_hash", F.sha2(F.when(tools == "[]", "").otherwise(tools), 256)).alias("version_hash"), count.alias("tool_count"), tools.alias("tools"))


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """S3 on files."""
    return snapshot_rows(whole_files(spark, path))
