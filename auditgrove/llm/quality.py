"""Quality rules with risk-controlled cutoffs.

Every document has one score: the largest of its rule values, each divided by the value at which a text is doubtful
(``SCALES``). Per stratum (language) one cutoff of the score is chosen from a fixed grid. Cutoffs are tried from lenient to strict on
labelled good texts; one passes if the exact binomial probability of seeing so few false rejections, were the true
rate ``alpha``, is at most ``delta / strata`` (Bonferroni over the strata; the grid needs no further share, as
fixed-sequence testing stops at the first cutoff that fails). So with probability 1 - delta no stratum loses by its cutoff more than
``alpha`` of its good texts that pass the base rule; what the fixed base rule rejects (for one, good texts of under 50 words) is beyond that bound. Among the passing cutoffs the one with the largest gain (bad texts rejected minus
``GOOD_WEIGHT`` times good ones) is used, the most lenient on ties; a stratum without a passing cutoff that gains has none.

Equal texts are one trial, good if any label calls them good, as copies fall together and would feign evidence. With four strata a cutoff needs 217 good
texts at no false rejection.

Defined results: a null or empty text has no words, fails the base rule and is rejected; a null language is a stratum
of its own; without labels nothing but the base rule rejects; repeated rows are judged one by one; of the label
columns only ``doc_id`` and ``quality`` are read, and extra columns of the documents are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, hash_strings, rolling, split_words, strings

#: Rule -> value at which a text is doubtful; the score is the largest quotient.
SCALES = {"symbol_ratio": 0.4, "repeat_ratio": 0.4, "dup_line_ratio": 0.5, "upper_ratio": 0.5, "shout_ratio": 0.5}
#: Cutoffs of the score, lenient first; a document above the cutoff of its stratum is rejected.
GRID = [8.0, 6.0, 5.0, 4.0, 3.0, 2.5, 2.0, 1.75, 1.5, 1.25, 1.0, 0.9, 0.8, 0.7, 0.6, 0.5]
ALPHA, DELTA, GOOD_WEIGHT = 0.02, 0.05, 5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Cutoffs that one task can hold; a stratum has one only with over 200 labelled good texts, so this many need 200 million labels.
MOST_CUTOFFS = 1_000_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATS = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("score", pa.float64()), ("text_hash", pa.int64())])
STATS_DDL = "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, score double, text_hash long"
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
SHOUTS = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def repeated_words(counts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a three-word window found twice or more in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    windows = rolling(hashes, 3)
    whole = owner[: len(windows)] == owner[2:] if len(windows) else np.empty(0, bool)
    at = np.flatnonzero(whole)
    order = np.lexsort((windows[at], owner[at]))
    w, o = windows[at][order], owner[at][order]
    same = (w[1:] == w[:-1]) & (o[1:] == o[:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(hashes), bool)
    for j in range(3):
        marked[at[twice] + j] = True
    return np.bincount(owner[marked], minlength=len(counts))


def repeated_lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line, of each text."""
    parts = pc.split_pattern(texts, "\n")
    coded = parts.flatten().dictionary_encode()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    worded = pc.not_equal(pc.ascii_trim_whitespace(coded.dictionary), "").to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    keep = worded[codes] if len(codes) else np.empty(0, bool)
    owner, codes = owner[keep].astype(np.int64), codes[keep].astype(np.int64)
    lines = np.bincount(owner, minlength=len(texts))
    distinct = np.unique(owner << 32 | codes) >> 32
    return lines, lines - np.bincount(distinct, minlength=len(texts))


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """All counts of a block of texts and their scores."""
    counts, codes, words = split_words(texts, lower=False)
    hashes = hash_strings(words)[codes] if len(codes) else np.empty(0, np.uint64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]

    sized = np.flatnonzero(np.diff(offsets) > 0)  # the others have no bytes between them
    starts = offsets[sized] - offsets[0]

    def per_text(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        if len(sized):
            total[sized] = np.add.reduceat(flags[data].view(np.uint8), starts, dtype=np.int64)
        return total

    out = {"n_words": counts, "word_chars": per_text(CODE_POINT & ~SPACE), "n_symbols": per_text(SYMBOLS), "n_repeat_words": repeated_words(counts, hashes)}
    lines, out["n_dup_lines"] = repeated_lines(texts)
    out["base_failed"] = (counts < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * counts)
    n = np.maximum(counts, 1)
    rules = {"symbol_ratio": out["n_symbols"] / n, "repeat_ratio": out["n_repeat_words"] / n, "dup_line_ratio": out["n_dup_lines"] / np.maximum(lines, 1)}
    rules |= {"upper_ratio": per_text(UPPER) / np.maximum(out["word_chars"], 1), "shout_ratio": per_text(SHOUTS) / n}
    return out | {"score": np.max([rules[r] / scale for r, scale in SCALES.items()], axis=0)}


def document_statistics(docs: DataFrame) -> DataFrame:
    """One row of counts, score and text hash per document; only doc_id, text and lang are read."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for table in blocks(batches, "text"):
            texts = strings(table, "text")
            yield emit(statistics(texts) | {"doc_id": table.column("doc_id"), "stratum": pc.fill_null(table.column("lang"), "?"), "text_hash": hash_strings(texts).view(np.int64)}, STATS)

    source = alias_free(docs, "doc_id", "text", "lang")
    return source.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).mapInArrow(run, STATS_DDL)


def log_tail(k: int, n: int, p: float) -> float:
    """log P(Binomial(n, p) <= k), exact up to rounding."""
    terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return top + math.log(sum(math.exp(t - top) for t in terms))


def choose(rejected_good: list[int], rejected_bad: list[int], good: int, alpha: float, delta: float) -> int | None:
    """Index of the cutoff to use, lenient first; None if no certified cutoff gains anything."""
    best, gain = None, 0
    for i, (g, b) in enumerate(zip(rejected_good, rejected_bad)):
        if not good or g > alpha * good or log_tail(g, good, alpha) > math.log(delta):
            break
        if b - GOOD_WEIGHT * g > gain:
            best, gain = i, b - GOOD_WEIGHT * g
    return best


def fit_cutoffs(stats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``stratum`` and ``cutoff`` of every stratum that has a certified one.

    Only counts per (stratum, grid step) meet; equal texts and counts are aggregated before the shuffles.
    """
    labelled = alias_free(labels, "doc_id", "quality").where("quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    joined = stats.where(~F.col("base_failed")).select("doc_id", "stratum", "text_hash", "score").join(labelled, "doc_id")
    trials = joined.groupBy("stratum", "text_hash").agg(F.max("quality").alias("quality"), F.max("score").alias("score"))
    step = sum(((F.col("score") > c).cast("int") for c in GRID), F.lit(0))  # the grid falls, so the last `step` cutoffs reject
    tally = trials.groupBy("stratum", step.alias("step")).agg(F.count(F.when(F.col("quality") == 1, 1)).alias("good"), F.count(F.when(F.col("quality") == 0, 1)).alias("bad"))
    strata = tally.agg(F.count_distinct("stratum").alias("strata"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        size = len(GRID)
        count = lambda col: [int(pdf.loc[pdf["step"] >= size - i, col].sum()) for i in range(size)]
        at = choose(count("good"), count("bad"), int(pdf["good"].sum()), alpha, delta / int(pdf["strata"].iloc[0]))
        return pd.DataFrame({"stratum": [pdf["stratum"].iloc[0]], "cutoff": [None if at is None else GRID[at]]}).dropna()

    return tally.crossJoin(F.broadcast(strata)).groupBy("stratum").applyInPandas(one, "stratum string, cutoff double")  # strata: one row


def judge(stats: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Statistics with ``cutoff`` and ``kept``: false for the base rule or a score above the cutoff of its stratum."""
    above = F.coalesce(F.col("score") > F.col("cutoff"), F.lit(False))
    return stats.join(cutoffs, "stratum", "left").withColumn("kept", ~(F.col("base_failed") | above))


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document with its counts, score, cutoff and ``kept``."""
    scratch = Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(document_statistics(docs), "statistics")
    return judge(stats, scratch.keep(fit_cutoffs(stats, labels, alpha, delta), "cutoffs"))


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass, all columns unchanged and no row shuffled.

    Texts are read twice (once to fit, once to filter) instead of being moved through a join. The cutoffs, a row per stratum that has one, go to
    the tasks in a broadcast; their number is bounded by the labels (``MOST_CUTOFFS``) and checked.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "quality")
    stats = scratch.keep(document_statistics(docs), "statistics")
    cutoffs = scratch.keep(fit_cutoffs(stats, labels, alpha, delta), "cutoffs")
    scratch.drop(stats)
    if cutoffs.count() > MOST_CUTOFFS:
        raise ValueError("more cutoffs than a task can hold: use quality_verdicts and join its rows")
    table = spark.sparkContext.broadcast({r["stratum"]: r["cutoff"] for r in cutoffs.collect()})
    bound_batches(spark)

    def run(batches):
        for block in blocks(batches, "text"):
            got = statistics(strings(block, "text"))
            cuts = np.array([table.value.get(s, math.inf) for s in pc.fill_null(block.column("lang"), "?").to_pylist()])
            yield from block.filter(pa.array(~(got["base_failed"] | (got["score"] > cuts)))).to_batches()

    return docs.mapInArrow(run, docs.schema)
