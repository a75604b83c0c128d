"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditgrove.llm import chat, collocations, decontam, filter_audit, html_diff, lm_bloom, near_dup, packing, quality, substring_dedup, token_store, url_rules, warc
from auditgrove.llm.shared import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "op2").path("store")
    token_store.write_store(table(spark, sf_dir, "documents"), root)
    return token_store.read_checksums(spark, root)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.component_table(table(spark, sf_dir, "documents"))


def op5_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_bloom.score_texts(table(spark, sf_dir, "documents"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_pages(table(spark, sf_dir, "pages"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "op7").path("archive")
    warc.write_archive(table(spark, sf_dir, "pages"), root)
    return warc.read_index(spark, root).drop("url")


def op8_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    windows = Scratch(spark, "op8").keep(chat.format_windows(turns.unionByName(extra)), "windows")
    return chat.read_back(windows).drop("n_windows")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_store, op3_html_text, op4_near_duplicates, op5_lm_scores, op6_url_rules, op7_warc, op8_chat_windows, op9_quality_rules, op10_packing, op11_collocations, op12_filter_audit, op13_substring_dedup)}

ORACLE_SQL: dict[str, str] = {"op6_url_rules": url_rules.ORACLE_SQL, "op11_collocations": collocations.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL, "op13_substring_dedup": substring_dedup.ORACLE_SQL}
