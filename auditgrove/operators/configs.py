"""Client configuration tables: clients, keys, merging, validation, sources and effective options."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Path component -> client, first component of the path that fits.
COMPONENTS = {
    "cursor": "cursor", ".cursor": "cursor", "windsurf": "windsurf", "claude": "claude", ".claude": "claude", "gemini": "gemini", ".gemini": "gemini", "zed": "zed", "zencoder": "zencoder",
    "helix": "helix", "nvim": "neovim", "neovim": "neovim", "code": "vscode", "vscode": "vscode", ".vscode": "vscode", "codeium": "windsurf", ".codeium": "windsurf",
}


def detect_client(path: Column) -> Column:
    """Client of a configuration file: by file name, else by the first telling path component, else by a known substring."""
    parts = F.filter(F.split(F.lower(path), r"[/\\]"), lambda c: c != "")
    file = F.element_at(F.split(path, r"[/\\]"), -1)
    has = lambda *names: F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))
    by_file = (
        F.when(file == "claude_desktop_config.json", "claude")
        .when((file == "settings.json") & has(".claude"), "claude-code").when((file == "settings.json") & has("code", "vscode", ".vscode"), "vscode")
        .when((file == "settings.local.json") & has(".claude"), "claude-code").when((file == "managed-settings.json") & has("claudecode", "claude-code"), "claude-code")
    )
    table = F.create_map(*[F.lit(x) for kv in COMPONENTS.items() for x in kv])

    def of(c: Column) -> Column:
        return F.coalesce(F.try_element_at(table, c), F.when(F.startswith(c, F.lit("cursor")) & ~F.contains(c, F.lit("vscode")), "cursor").when(F.contains(c, F.lit("microsoft")) & F.contains(c, F.lit("code")), "vscode"))

    by_part = F.try_element_at(F.array_compact(F.transform(parts, of)), F.lit(1))
    return F.coalesce(by_file, by_part, F.when(F.contains(F.lower(path), F.lit("rooveterinaryinc.cursor-mcp")), "cursor"))


def normal_url(url: Column) -> Column:
    """URL form for comparison: trimmed, lower case, no trailing slashes, loopback addresses as localhost."""
    low = F.lower(F.trim(url))
    bare = F.when(low.isin("http://", "https://"), low).otherwise(F.regexp_replace(low, "/+$", ""))
    return F.replace(F.replace(bare, F.lit("127.0.0.1"), F.lit("localhost")), F.lit("0.0.0.0"), F.lit("localhost"))


def dedup_key(configs: DataFrame) -> DataFrame:
    """``http:`` and the normal URL, or ``stdio:name:command:args``."""
    stdio = F.concat(F.lit("stdio:"), F.coalesce("name", F.lit("")), F.lit(":"), F.coalesce("command", F.lit("")), F.lit(":"), F.coalesce(F.array_join("args", ","), F.lit("")))
    return configs.withColumn("dedup_key", F.when(F.col("url").isNotNull(), F.concat(F.lit("http:"), normal_url(F.col("url")))).otherwise(stdio))


def merge_configs(configs: DataFrame) -> DataFrame:
    """One definition per key, that of the highest precedence (then the largest server_id)."""
    best = Window.partitionBy("dedup_key").orderBy(F.desc("precedence"), F.desc("server_id"))
    return configs.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn")


def merge_options(configs: DataFrame, by: str, options: tuple[str, ...]) -> DataFrame:
    """Options merged field by field, the value of the highest precedence that has one."""
    order = F.struct("precedence", "server_id")
    return configs.groupBy(by).agg(*[F.max_by(F.col(o), F.when(F.col(o).isNotNull(), order)).alias(o) for o in options])


def merge_headers(configs: DataFrame, by: str) -> DataFrame:
    """Header values merged name by name, one row each."""
    rows = configs.select(by, "precedence", "server_id", F.explode("auth_headers").alias("header_name", "header_value"))
    return rows.groupBy(by, "header_name").agg(F.max_by("header_value", F.struct("precedence", "server_id")).alias("header_value"))


def violation(rule: str, bad: Column, detail: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail")))


def each(rule: str, values: Column, bad) -> Column:
    """One violation per bad element of an array of strings."""
    found = F.filter(F.coalesce(values, F.array().cast("array<string>")), bad)
    return F.transform(found, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("detail")))


def validate_configs(configs: DataFrame) -> DataFrame:
    """C4: a row per violation: file, server_id, rule, detail. Lengths are bytes; the file-wide rules use one window per file."""
    url, command, name = F.trim("url"), F.col("command"), F.col("name")
    only_url, only_command = F.col("url").isNotNull() & command.isNull(), command.isNotNull() & F.col("url").isNull()
    size, web = F.octet_length, F.col("url").rlike(r"^\s*https?://")
    keys, values = F.map_keys("env"), F.map_values("env")
    hk, hv = F.map_keys("auth_headers"), F.map_values("auth_headers")
    per_file = Window.partitionBy("file")
    first = lambda c: F.row_number().over(Window.partitionBy("file", c).orderBy("server_id"))
    rows = dedup_key(configs).withColumn("n_servers", F.count("*").over(per_file)).withColumn("trimmed", F.trim(name))
    rows = rows.withColumn("key_place", first("dedup_key")).withColumn("name_place", first("trimmed"))
    single = [
        violation("url_and_command", F.col("url").isNotNull() & command.isNotNull(), F.lit("")),
        violation("no_url_or_command", F.col("url").isNull() & command.isNull(), F.lit("")),
        violation("empty_command", only_command & (F.trim(command) == ""), F.lit("")),
        violation("long_command", only_command & (size(command) > 1024), size(command)),
        violation("command_characters", only_command & command.rlike("[\\x00\\n\\r]"), F.lit("")),
        violation("many_arguments", only_command & (F.size("args") > 100), F.size("args")),
        violation("many_variables", F.size("env") > 100, F.size("env")),
        violation("empty_url", only_url & (F.col("url") == ""), F.lit("")),
        violation("long_url", only_url & (size(url) > 2048), size(url)),
        violation("stdio_url", only_url & F.startswith(url, F.lit("stdio:")), url),
        violation("url_scheme", only_url & (F.col("url") != "") & ~web & ~F.startswith(url, F.lit("stdio:")), url),
        violation("port_zero", only_url & web & url.rlike(r"^https?://[^/?#]*:0+([/?#]|$)"), url),
        violation("empty_name", F.trim(name) == "", F.lit("")),
        violation("long_name", size(F.trim(name)) > 255, size(F.trim(name))),
        violation("long_description", size("description") > 1000, size("description")),
        violation("many_servers", F.col("n_servers") > 100, F.col("n_servers")),
        violation("duplicate_key", F.col("key_place") > 1, F.col("dedup_key")),
        violation("duplicate_name", F.col("trimmed").isNotNull() & (F.col("name_place") > 1), F.col("trimmed")),
    ]
    several = [
        each("long_argument", F.when(only_command, F.col("args")), lambda a: size(a) > 4096),
        each("argument_characters", F.when(only_command, F.col("args")), lambda a: F.contains(a, F.lit("\0"))),
        each("empty_variable", keys, lambda k: F.trim(k) == ""),
        each("long_variable", keys, lambda k: size(k) > 1024),
        each("variable_characters", keys, lambda k: ~k.rlike("^[A-Za-z0-9_]*$")),
        each("variable_digit", keys, lambda k: k.rlike("^[0-9]")),
        each("long_variable_value", values, lambda v: size(v) > 8192),
        each("empty_header", hk, lambda k: F.trim(k) == ""),
        each("empty_header_value", hv, lambda v: F.trim(v) == ""),
        each("long_header", hk, lambda k: size(k) > 1024),
        each("long_header_value", hv, lambda v: size(v) > 4096),
    ]
    return rows.select("file", "server_id", F.explode(F.concat(F.array_compact(F.array(*single)), *several)).alias("v")).select("file", "server_id", "v.rule", "v.detail")


def drop_invalid(configs: DataFrame, violations: DataFrame, scope: str = "file") -> DataFrame:
    """Definitions without violations; with scope ``file`` one bad server drops its whole file."""
    keys = ["file"] if scope == "file" else ["file", "server_id"]
    return configs.join(violations.select(*keys).distinct(), keys, "left_anti")


def tag_source(configs: DataFrame, source: Column) -> DataFrame:
    """The client's name behind the description, as ``[IDE:name]``."""
    return configs.withColumn("description", F.concat_ws(" ", "description", F.concat(F.lit("[IDE:"), source, F.lit("]"))))


def source_of(description: Column) -> Column:
    """The client named by the last tag of a description."""
    found = F.regexp_extract(description, r"(?s)^.*\[IDE:([^\]]*)\]", 1)
    return F.when(F.coalesce(description.rlike(r"\[IDE:[^\]]*\]"), F.lit(False)), found).otherwise("IDE Configs")


def effective_options(configs: DataFrame, global_options: dict, request: dict) -> DataFrame:
    """Options of each server over the global ones over the request's, and whether they are valid."""
    out = configs
    for o in ("timeout", "http_timeout", "format", "detailed"):
        own = [F.col(o)] if o in configs.columns else []
        out = out.withColumn(f"effective_{o}", F.coalesce(*own, F.lit(global_options.get(o)), F.lit(request.get(o))))
    t, h = F.col("effective_timeout"), F.col("effective_http_timeout")
    return out.withColumn("valid", (t > 0) & (h > 0) & (t >= h) & t.between(1, 3600) & h.between(1, 3600))


def effective_headers(configs: DataFrame, global_headers: dict[str, str], request: dict[str, str]) -> DataFrame:
    """Header rows per server in the same order of precedence."""
    layers = [F.map_entries(F.create_map(*[F.lit(x) for kv in d.items() for x in kv])) if d else F.array().cast("array<struct<key:string,value:string>>") for d in (request, global_headers)]
    own = F.coalesce(F.map_entries("auth_headers"), F.array().cast("array<struct<key:string,value:string>>"))

    def ranked_by(rank: int, entries: Column) -> Column:
        return F.transform(entries, lambda e: F.struct(e["key"].alias("name"), F.struct(F.lit(rank).alias("rank"), e["value"].alias("value")).alias("v")))

    ranked = [ranked_by(i, a) for i, a in enumerate([*layers, own])]
    rows = configs.select("server_id", F.explode(reduce(lambda a, b: F.concat(a, b), ranked)).alias("h"))
    return rows.groupBy("server_id", F.col("h.name").alias("header_name")).agg(F.max(F.col("h.v"))["value"].alias("header_value"))
