"""URLs of items and cross-origin analysis per server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANYWHERE = r"""((?:https?|wss?)://[^\s"'<>]+)"""
WHOLE = r"^(https?|wss?)://"
#: Stand for an escaped backslash and an escaped quote while strings are cut out; JSON text holds no such characters.
BACKSLASH, QUOTE = "\x01", "\x02"


def tagged(urls: Column, field: str) -> Column:
    return F.transform(urls, lambda u: F.struct(F.lit(field).alias("field"), u.alias("url")))


def json_strings(text: Column) -> Column:
    """Every string of a JSON text, keys and values at any depth, in order and decoded; none if the text is no JSON.

    In valid JSON each quote that is not escaped opens or closes a string, so one linear pass meets what a walk of the parsed tree
    meets, at any depth and without a step per level. Strings with an escape are decoded by the JSON parser.
    """
    marked = F.replace(F.replace(text, F.lit("\\\\"), F.lit(BACKSLASH)), F.lit('\\"'), F.lit(QUOTE))
    found = F.regexp_extract_all(marked, F.lit('"([^"]*)"'), 1)

    def decoded(s: Column) -> Column:
        raw = F.replace(F.replace(s, F.lit(QUOTE), F.lit('\\"')), F.lit(BACKSLASH), F.lit("\\\\"))
        parsed = F.try_parse_json(F.concat(F.lit('"'), raw, F.lit('"'))).cast("string")
        return F.when(s.contains("\\") | s.contains(QUOTE) | s.contains(BACKSLASH), parsed).otherwise(s)

    return F.when(F.get_json_object(text, "$").isNotNull(), F.transform(found, decoded)).otherwise(F.array().cast("array<string>"))


def json_urls(text: Column) -> Column:
    """The strings of a JSON text that are URLs as a whole. Only a text with a scheme's colon or an escape is parsed at all."""
    mayhold = text.contains("://") | text.contains("\\")
    return F.when(mayhold, F.filter(json_strings(text), lambda s: s.rlike(WHOLE))).otherwise(F.array().cast("array<string>"))


def extract_urls(items: DataFrame, mode: str = "leaf", fields: tuple[str, ...] = ("description", "uri"), json_fields: tuple[str, ...] = ("input_schema", "output_schema", "parameters", "raw_json", "metadata")) -> DataFrame:
    """A row per URL occurrence and field. ``leaf``: whole strings that are URLs, in JSON fields keys and values at any depth with
    escapes decoded; ``anywhere``: URLs inside texts and JSON strings as well. Fields that the items lack are passed over; a null or
    invalid JSON field has no URL."""
    parts, have = [], set(items.columns)
    none = F.array().cast("array<string>")
    for f in (f for f in fields if f in have):
        if mode == "leaf":
            found = F.when(F.col(f).rlike(WHOLE), F.array(F.col(f))).otherwise(none)
        else:
            found = F.coalesce(F.regexp_extract_all(f, F.lit(ANYWHERE), 1), none)
        parts.append(tagged(found, f))
    for f in (f for f in json_fields if f in have):
        if mode == "leaf":
            found = json_urls(F.col(f))
        else:
            found = F.flatten(F.transform(json_strings(F.col(f)), lambda s: F.regexp_extract_all(s, F.lit(ANYWHERE), 1)))
        parts.append(tagged(F.coalesce(found, none), f))
    return items.select("server", "item_type", "item_id", "name", F.explode(F.concat(*parts)).alias("u")).select("server", "item_type", "item_id", "name", "u.field", "u.url")


def root_domain(host: Column) -> Column:
    """Last two labels; localhost and numeric hosts whole."""
    labels = F.split(host, r"\.")
    whole = (host == "localhost") | host.rlike(r"^[0-9.]+$") | (F.size(labels) < 2)
    return F.when(whole, host).otherwise(F.concat_ws(".", F.element_at(labels, -2), F.element_at(labels, -1)))


def suffix_roots(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``host`` and ``root_domain`` of every distinct host under a table of public suffixes (column ``suffix``): the longest suffix of
    the host that the table holds and one label more; a host that is itself a suffix stays whole, one without a listed suffix gets no row."""
    labels = F.split("host", r"\.")
    named = hosts.select("host").distinct().where(~F.col("host").rlike(r"^[0-9.]+$"))
    tails = named.select("host", labels.alias("labels"), F.explode(F.sequence(F.lit(1), F.size(labels))).alias("at"))
    tails = tails.withColumn("suffix", F.array_join(F.slice("labels", F.col("at"), F.size("labels")), "."))
    known = suffixes.where("suffix is not null").select(F.lower(F.ltrim(F.col("suffix"), F.lit("."))).alias("suffix")).distinct()
    longest = tails.join(known, "suffix").groupBy("host").agg(F.min("at").alias("at"), F.first("labels").alias("labels"))
    return longest.select("host", F.array_join(F.slice("labels", F.greatest(F.col("at") - 1, F.lit(1)), F.size("labels")), ".").alias("root_domain"))


def url_facts(urls: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Scheme, host and root domain; URLs without a host are dropped. The host ends at a slash, colon, query or fragment; user-info is cut.

    The root domain is the last two labels, or, with a table of public ``suffixes``, the longest listed suffix and one label more."""
    authority = F.regexp_extract("url", r"^[A-Za-z]+://(?:[^/?#@]*@)?([^/?#:\s]*)", 1)
    facts = urls.withColumn("scheme", F.lower(F.regexp_extract("url", r"^([A-Za-z]+)://", 1))).withColumn("host", F.lower(authority)).where("host <> ''")
    if suffixes is None:
        return facts.withColumn("root_domain", root_domain(F.col("host")))
    listed = suffix_roots(facts, suffixes).withColumnRenamed("root_domain", "listed_root")
    return facts.join(listed, "host", "left").withColumn("root_domain", F.coalesce("listed_root", root_domain(F.col("host")))).drop("listed_root").select(*facts.columns, "root_domain")


def domain_users(facts: DataFrame) -> DataFrame:
    """Who uses each root domain of a server, and how often; a row per user, so that no row grows with its server."""
    return facts.groupBy("server", "root_domain", F.concat("item_type", F.lit(":"), "name").alias("user")).agg(F.count("*").alias("uses"))


def domain_distribution(facts: DataFrame) -> DataFrame:
    """Uses of each root domain per server, and all its users in one array, as a report shows them; ``domain_users`` gives them as rows."""
    user = F.concat("item_type", F.lit(":"), "name")
    return facts.groupBy("server", "root_domain").agg(F.count("*").alias("uses"), F.array_sort(F.collect_set(user)).alias("users"))


def cross_domain_findings(facts: DataFrame) -> DataFrame:
    """Servers with more than one root domain. Counted per (server, domain) first, so a large server is no large group."""
    per = facts.groupBy("server", "root_domain").agg(F.count("*").alias("uses"))
    found = per.groupBy("server").agg(F.count("*").alias("n_domains"), F.array_join(F.array_sort(F.collect_list("root_domain")), ", ").alias("domains"), F.sum("uses").alias("total_uses")).where("n_domains > 1")
    text = F.format_string("Cross-domain contamination detected across %d domains: %s", F.col("n_domains"), F.col("domains"))
    return found.withColumn("rule_name", F.lit("CrossDomainContamination")).withColumn("severity", F.lit("HIGH")).withColumn("matched_text", text)


def domain_outliers(facts: DataFrame) -> DataFrame:
    """Every use of a domain other than its server's most used one; ties go to the smallest domain."""
    per = facts.groupBy("server", "root_domain").agg(F.count("*").alias("uses"))
    common = per.withColumn("rn", F.row_number().over(Window.partitionBy("server").orderBy(F.desc("uses"), "root_domain"))).where("rn = 1").select("server", F.col("root_domain").alias("common_domain"))
    out = facts.join(common, "server").where("root_domain <> common_domain")
    text = F.concat("item_type", F.lit(":"), "name", F.lit(" uses domain '"), "root_domain", F.lit("' instead of common domain '"), "common_domain", F.lit("'"))
    return out.withColumn("rule_name", F.lit("DomainOutlier")).withColumn("severity", F.lit("HIGH")).withColumn("matched_text", text)


def mixed_schemes(facts: DataFrame) -> DataFrame:
    """Servers that use both http and https, with their distinct hosts counted."""
    per = facts.groupBy("server", "host").agg(F.bool_or(F.col("scheme") == "http").alias("http"), F.bool_or(F.col("scheme") == "https").alias("https"))
    found = per.groupBy("server").agg(F.bool_or("http").alias("http"), F.bool_or("https").alias("https"), F.count("*").alias("n_hosts")).where("http and https")
    return found.select("server", "n_hosts", F.lit("MixedSecuritySchemes").alias("rule_name"), F.lit("MEDIUM").alias("severity"))
