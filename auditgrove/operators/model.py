"""Model-assisted review: item cards, prompt batches, scoring, reply parsing and issue normalisation."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.functions.storage import shared_folder

BATCH_SIZE = 10

#: Issue type -> (default severity, default sentence).
ISSUE_TYPES = {
    "ToolPoisoning": ("CRITICAL", "Tool with destructive or malicious intent"),
    "SQLInjection": ("CRITICAL", "Tool allowing SQL injection attacks"),
    "CommandInjection": ("CRITICAL", "Tool that may execute system commands"),
    "AuthBypass": ("CRITICAL", "Tool allowing unauthorized access"),
    "PathTraversal": ("HIGH", "Tool allowing directory traversal attacks"),
    "PromptInjection": ("HIGH", "Prompt vulnerable to injection attacks"),
    "Jailbreak": ("HIGH", "Prompt that could bypass AI safety measures"),
    "SecretsLeakage": ("HIGH", "Tool processing sensitive credentials"),
    "PIILeakage": ("MEDIUM", "Tool processing personal information"),
}
#: What a batch of each kind is asked for.
TASKS = {
    "tool": "Review these tools for ToolPoisoning and PromptInjection.",
    "prompt": "Review these prompts for PromptInjection, Jailbreak and PIILeakage.",
    "resource": "Review these resources for PathTraversal and SecretsLeakage.",
}
REPLY = "array<struct<tool_name string, prompt_name string, resource_uri string, name string, found_issue boolean, details string, issue_type string, severity string, message string, issues array<struct<issue_type string, severity string, message string, details string>>>>"


def format_items(items: DataFrame) -> DataFrame:
    """L1: ``card``, the text shown to a model for an item (without its number)."""
    schema = F.col("input_schema")
    properties = F.get_json_object(schema, "$.properties")
    keys = F.json_object_keys(properties)
    params = F.when(schema.isNull(), "no schema").when(properties.isNull(), "no properties").when(keys.isNull(), "complex schema").otherwise(F.array_join(keys, ", "))
    described = F.concat(F.lit("Description: "), F.coalesce("description", F.lit("No description")))
    tool = F.concat_ws("\n", described, F.concat(F.lit("Category: "), F.coalesce("category", F.lit("No category"))), F.concat(F.lit("Tags: "), F.coalesce(F.array_join("tags", ", "), F.lit(""))), F.concat(F.lit("Parameters: "), params))
    prompt = F.concat_ws("\n", described, F.lit("Arguments: No arguments"))
    resource = F.concat_ws("\n", F.concat(F.lit("URI: "), F.coalesce("uri", F.lit(""))), described)
    return items.withColumn("card", F.when(F.col("item_type") == "tool", tool).when(F.col("item_type") == "prompt", prompt).otherwise(resource))


def number_ids(counted: DataFrame, keys: list[str]) -> DataFrame:
    """``before``, the copies of smaller ids within the group of the first two keys, for every row of counted ids; the keys are named with a line behind."""
    spark = counted.sparkSession
    folder = shared_folder(spark, "ids")
    counted.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()).write.parquet(folder)
    dealt = spark.read.parquet(folder)  # written, so that both uses below see the same partitions
    group, earlier = keys[:2], (Window.unboundedPreceding, -1)
    within = F.sum("copies").over(Window.partitionBy("part", *group).orderBy(keys[2]).rowsBetween(*earlier))
    parts = dealt.groupBy("part", *group).agg(F.sum("copies").alias("copies"))  # a row per partition that a group lies in
    start = parts.select("part", *[F.col(k).alias(f"{k}_") for k in group], F.sum("copies").over(Window.partitionBy(*group).orderBy("part").rowsBetween(*earlier)).alias("start"))
    placed = dealt.withColumn("within", within).join(start.withColumnRenamed("part", "part_"), (F.col("part") == F.col("part_")) & F.col(group[0]).eqNullSafe(F.col(f"{group[0]}_")) & F.col(group[1]).eqNullSafe(F.col(f"{group[1]}_")))
    return placed.select(*[F.col(k).alias(f"{k}_") for k in keys[2:]], *[F.col(f"{k}_") for k in group], (F.coalesce("within", F.lit(0)) + F.coalesce("start", F.lit(0))).alias("before"))


def prompt_batches(cards: DataFrame, size: int = BATCH_SIZE, order: str = "item_id") -> DataFrame:
    """L2: per (server, type) batches of ``size`` items: names, text of the request, and its JSON body.

    Items are numbered by id alone, and the cards then move by (server, type, id), so a server with many items never gathers its texts. The ids are range-sorted and
    written once; numbers run within a partition and the partitions' counts are added up, so no task holds the ids of a server. Items with one id are
    ordered by name and card. The batches meet by their number.
    """
    keys = ["server", "item_type", order]
    numbered = number_ids(cards.groupBy(*keys).agg(F.count("*").alias("copies")), keys)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    copy = F.row_number().over(Window.partitionBy(*keys).orderBy("name", "card")) - 1
    placed = cards.select(*keys, "name", "card").join(numbered, same).select("server", "item_type", "name", "card", (F.col("before") + copy).alias("n")).withColumn("batch_index", F.floor(F.col("n") / size))
    title = F.concat(F.lit("\n\n"), F.upper("item_type"), F.lit(" "), (F.col("n") % size + 1).cast("string"), F.lit(": "), "name", F.lit("\n"), "card")
    grouped = placed.withColumn("text", title).groupBy("server", "item_type", "batch_index").agg(F.array_sort(F.collect_list(F.struct("n", "name", "text"))).alias("rows"))
    task = F.create_map(*[F.lit(x) for kv in TASKS.items() for x in kv])[F.col("item_type")]
    out = grouped.withColumn("item_names", F.transform("rows", lambda r: r["name"])).withColumn("prompt", F.concat(task, F.array_join(F.transform("rows", lambda r: r["text"]), "")))
    return out.withColumn("request_body", F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages")))).drop("rows")


def call(client: Callable[[str], str], prompt: str, attempts: int, wait: float, most_wait: float) -> tuple[str | None, str | None, int]:
    """Reply, error and the number of attempts; the wait doubles between them."""
    for n in range(1, attempts + 1):
        try:
            return client(prompt), None, n
        except Exception as e:  # noqa: BLE001  the client is the user's
            error = str(e)
        if n < attempts:
            time.sleep(min(wait * 2 ** (n - 1), most_wait))
    return None, error, attempts


def score_with_clients(batches: DataFrame, factory: Callable[[], Callable[[str], str]], workers: int | None = None, at_once: int = 4, attempts: int = 5, wait: float = 0.1, most_wait: float = 1.0) -> DataFrame:
    """L3: replies of a model service to the batches, with ``error`` and ``attempts``; a batch that fails every time gives an error row.

    ``factory`` is called once in each task that has rows and returns the client, a function from prompt to reply; if it has a ``close`` method, that is called at the end. A task keeps
    ``at_once`` requests under way; ``workers`` bounds the tasks, so ``workers`` times ``at_once`` requests at most are open at a time. Time limits are the client's.
    A task that is run again asks again.
    """
    rows = batches.select("server", "item_type", "batch_index", "prompt")
    if workers:
        rows = rows.repartition(workers)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = None
        with ThreadPoolExecutor(at_once) as pool:
            try:
                for part in parts:
                    if client is None and len(part):
                        client = factory()
                    replies, errors, tries = zip(*pool.map(lambda p: call(client, p, attempts, wait, most_wait), part["prompt"])) if len(part) else ((), (), ())
                    yield part.drop(columns="prompt").assign(reply=list(replies), error=list(errors), attempts=list(tries))
            finally:
                if hasattr(client, "close"):
                    client.close()

    return rows.mapInPandas(run, "server string, item_type string, batch_index long, reply string, error string, attempts int")


def score_batches(batches: DataFrame, scorer: Callable[[str], str] | None, workers: int | None = None) -> DataFrame:
    """L3: replies of a scorer, a function from prompt to reply that needs no client of its own, to the batches. Each is asked once;
    without a scorer the result is empty."""
    if scorer is None:
        return batches.where(F.lit(False)).select("server", "item_type", "batch_index", F.lit(None).cast("string").alias("reply"), F.lit(None).cast("string").alias("error"))
    return score_with_clients(batches, lambda: scorer, workers, at_once=1, attempts=1).drop("attempts")


def reply_array(text: Column) -> Column:
    """Text from the first ``[`` to the last ``]``; the whole text without them."""
    first, last = F.instr(text, "["), F.length(text) - F.instr(F.reverse(text), "]") + 1
    return F.when((first > 0) & (F.instr(text, "]") > 0) & (last > first), F.substring(text, first, last - first + 1)).otherwise(text)


def parse_responses(replies: DataFrame) -> DataFrame:
    """L4: a row per issue (``kind`` issue), per item detail (``kind`` details) or broken reply (``kind`` error).

    An element that names a tool counts only with a boolean ``found_issue``; one without is a single issue.
    """
    body = reply_array(F.col("reply"))
    parsed = F.from_json(body, REPLY)
    good = F.coalesce(F.try_parse_json(body).isNotNull() & F.startswith(F.ltrim(body), F.lit("[")), F.lit(False))
    rows = replies.withColumn("good", good).withColumn("elements", F.when(good, parsed))
    errors = rows.where(~F.col("good") & ~F.contains(F.coalesce("reply", F.lit("")), F.lit("[]")))
    e = rows.where("good").select("reply_id", F.explode("elements").alias("e"))
    named = e.where("e.tool_name is not null and e.found_issue is not null")
    columns = ["reply_id", "kind", "target_name", "issue_type", "severity", "message", "details"]
    issues = named.where("e.found_issue").select("reply_id", F.lit("issue").alias("kind"), F.col("e.tool_name").alias("target_name"), F.explode("e.issues").alias("i")).select("reply_id", "kind", "target_name", "i.issue_type", "i.severity", "i.message", "i.details")
    details = named.where("e.details is not null").select("reply_id", F.lit("details").alias("kind"), F.col("e.tool_name").alias("target_name"), F.lit(None).cast("string").alias("issue_type"), F.lit(None).cast("string").alias("severity"), F.lit(None).cast("string").alias("message"), F.col("e.details").alias("details"))
    single = e.where("e.tool_name is null").select("reply_id", F.lit("issue").alias("kind"), F.coalesce("e.prompt_name", "e.resource_uri", "e.name").alias("target_name"), "e.issue_type", "e.severity", "e.message", "e.details")
    broken = errors.select("reply_id", F.lit("error").alias("kind"), *[F.lit(None).cast("string").alias(c) for c in columns[2:6]], F.col("reply").alias("details"))
    return issues.unionByName(details).unionByName(single).unionByName(broken).select(*columns)


def normalise_issues(raw: DataFrame) -> DataFrame:
    """Complete issues of a known type; severity in upper case, unknown ones MEDIUM; message behind the type's sentence."""
    sentence = F.create_map(*[F.lit(x) for k, v in ISSUE_TYPES.items() for x in (k, v[1])])[F.col("issue_type")]
    severity = F.upper("severity")
    known = raw.where("kind = 'issue'").dropna(subset=["issue_type", "severity", "message", "details"]).where(F.col("issue_type").isin(*ISSUE_TYPES))
    return known.withColumn("severity", F.when(severity.isin("CRITICAL", "HIGH", "MEDIUM", "LOW"), severity).otherwise("MEDIUM")).withColumn("message", F.concat(sentence, F.lit(": "), "message"))
