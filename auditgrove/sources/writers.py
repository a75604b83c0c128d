"""Sinks: flat finding tables and nested result documents."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.functions.storage import shared_folder
from auditgrove.operators.results import embed_results, report_lines, security_summary


def write_findings(findings: DataFrame, path: str, scan_date: str, mode: str = "overwrite") -> None:
    """Findings as Parquet, a directory per scan date.

    Writing a date again replaces its rows, also by none, and leaves other dates as they are; a run that fails on the way leaves the date empty until it is repeated.
    ``mode="append"`` adds to a date instead.
    """
    findings.drop("scan_date").write.mode(mode).parquet(f"{path.rstrip('/')}/scan_date={quote(scan_date, safe='-_. ')}")


def stored(findings: DataFrame) -> DataFrame:
    """The findings written once below ``spark.checkpoint.dir`` and reread. What is read more than once (results, summaries, reports) then scans its items once."""
    folder = shared_folder(findings.sparkSession, "findings")
    findings.write.parquet(folder)
    return findings.sparkSession.read.schema(findings.schema).parquet(folder)


def nested_results(items: DataFrame, findings: DataFrame) -> DataFrame:
    """One JSON document per server: its summary and its items with their findings.

    A document holds all items of its server, so its size is that of the server; ids and names only, no item texts.
    """
    embedded = embed_results(items.select("server", "item_type", "item_id", "name"), findings)
    per = embedded.groupBy("server").agg(F.array_sort(F.collect_list(F.struct("item_type", "item_id", "name", "findings"))).alias("items"))
    summary = security_summary(items, findings)
    joined = per.join(summary.select("server", F.struct("tool_issues", "prompt_issues", "resource_issues", "rule_issues", "total_issues").alias("summary")), "server")
    return joined.select("server", F.to_json(F.struct("server", "summary", "items")).alias("document"))


def write_nested(items: DataFrame, findings: DataFrame, path: str, mode: str = "error") -> None:
    """The documents as text, one per line."""
    nested_results(items, findings).select("document").write.mode(mode).text(path)


def wrapped_results(items: DataFrame, findings: DataFrame, scan_type: str = "multi") -> DataFrame:
    """The lines of one JSON document over all servers, with ``place`` and ``server`` giving their order.

    A head line with scan type and number of servers, a line per server, and a closing line; a comma leads all servers but the first.
    """
    documents = nested_results(items, findings)
    edge = documents.agg(F.count("*").alias("n"), F.min("server").alias("first"))  # one row
    head = edge.select(F.lit(0).alias("place"), F.lit("").alias("server"), F.concat(F.lit('{"scan_type":'), F.to_json(F.array(F.lit(scan_type))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(scan_type)))) - 2), F.lit(',"total_servers":'), F.col("n").cast("string"), F.lit(',"results":[')).alias("line"))
    comma = F.when(F.col("server").eqNullSafe(F.col("first")), "").otherwise(",")
    body = documents.crossJoin(F.broadcast(edge)).select(F.lit(1).alias("place"), "server", F.concat(comma, F.col("document")).alias("line"))
    end = edge.select(F.lit(2).alias("place"), F.lit("").alias("server"), F.lit("]}").alias("line"))
    return head.unionByName(body).unionByName(end)


def write_wrapped(items: DataFrame, findings: DataFrame, path: str, scan_type: str = "multi", mode: str = "error") -> None:
    """The document as text files; put together in order of their names they are one JSON document. No task holds more than one server."""
    wrapped_results(items, findings, scan_type).orderBy("place", "server").select("line").write.mode(mode).text(path)


def nested_lines(items: DataFrame, findings: DataFrame) -> DataFrame:
    """The documents of ``nested_results`` as lines, with ``server``, ``place``, ``item_type``, ``item_id`` and ``line`` giving their order.

    A head line with the summary, a line per item with its findings, and a closing line; a comma leads all items of a server but the first. No row
    holds more than one item (equal rows of one item share a line), so a document may be larger than a row or a task.
    """
    embedded = embed_results(items.select("server", "item_type", "item_id", "name"), findings)
    text = F.to_json(F.struct("item_type", "item_id", "name", "findings"))
    body = embedded.select("server", "item_type", "item_id", text.alias("text")).groupBy("server", "item_type", "item_id", "text").agg(F.count("*").cast("int").alias("copies"))
    first = body.groupBy("server").agg(F.min(F.struct("item_type", "item_id", "text")).alias("first"))
    comma = F.when(F.struct("item_type", "item_id", "text").eqNullSafe(F.col("first")), "").otherwise(",")
    told = F.concat(comma, F.col("text"), F.repeat(F.concat(F.lit(","), "text"), F.col("copies") - 1))
    middle = body.join(first, "server").select("server", F.lit(1).alias("place"), "item_type", "item_id", told.alias("line"))
    none = F.lit(None).cast("string")
    per = security_summary(items, findings)
    opened = F.to_json(F.struct("server", F.struct("tool_issues", "prompt_issues", "resource_issues", "rule_issues", "total_issues").alias("summary")))
    head = per.select("server", F.lit(0).alias("place"), none.alias("item_type"), none.alias("item_id"), F.concat(F.substr(opened, F.lit(1), F.length(opened) - 1), F.lit(',"items":[')).alias("line"))
    end = per.select("server", F.lit(2).alias("place"), none.alias("item_type"), none.alias("item_id"), F.lit("]}").alias("line"))
    return head.unionByName(middle).unionByName(end)


def write_nested_lines(items: DataFrame, findings: DataFrame, path: str, mode: str = "error") -> None:
    """The documents line by line as text files, which in order of their names hold one document after the other. A server may fill several files."""
    nested_lines(items, findings).orderBy("server", "place", "item_type", "item_id", "line").select("line").write.mode(mode).text(path)


def write_reports(scans: DataFrame, items: DataFrame, findings: DataFrame, path: str, mode: str = "error") -> None:
    """A10: the reports with every line as text files, which in order of their names hold one report after the other. A server may fill several files."""
    report_lines(scans, items, findings).orderBy("server", "place", "rank", "item_id", "finding_type", "line").select("line").write.mode(mode).text(path)


def wrapped_lines(items: DataFrame, findings: DataFrame, scan_type: str = "multi") -> DataFrame:
    """The one document over all servers as lines, of which none holds more than one item; ``part``, ``server``, ``place``, ``item_type``, ``item_id`` and ``line`` give their order."""
    lines = nested_lines(items, findings)
    edge = items.select("server").distinct().agg(F.count("*").alias("n"), F.min("server").alias("first"))  # one row
    quoted = F.to_json(F.array(F.lit(scan_type)))
    head = edge.select(F.lit(0).alias("part"), F.concat(F.lit('{"scan_type":'), F.substr(quoted, F.lit(2), F.length(quoted) - 2), F.lit(',"total_servers":'), F.col("n").cast("string"), F.lit(',"results":[')).alias("line"))
    comma = F.when((F.col("place") == 0) & (F.col("server") != F.col("first")), ",").otherwise("")
    body = lines.crossJoin(F.broadcast(edge)).select(F.lit(1).alias("part"), "server", "place", "item_type", "item_id", F.concat(comma, F.col("line")).alias("line"))
    end = edge.select(F.lit(2).alias("part"), F.lit("]}").alias("line"))
    return body.unionByName(head, allowMissingColumns=True).unionByName(end, allowMissingColumns=True)


def write_wrapped_lines(items: DataFrame, findings: DataFrame, path: str, scan_type: str = "multi", mode: str = "error") -> None:
    """That document as text files; put together in order of their names they are one JSON document. A server may fill several files."""
    wrapped_lines(items, findings, scan_type).orderBy("part", "server", "place", "item_type", "item_id", "line").select("line").write.mode(mode).text(path)
