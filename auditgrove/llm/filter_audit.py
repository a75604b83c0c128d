"""Interaction of document filters, by sorted posting lists.

Five filters judge every whole text: A under 50 words; B fewer than 65 distinct words in 100; C more than 5 capitals A-Z in 100
code points; D a character of ``#$%&*|``; E a text that some smaller doc_id has as well, table-wide. Every part (``source``) is cut into ranges of ascending ids; a
range keeps one ascending list of row numbers per filter, and two more for labelled good and toxic rows (``posting_lists``). Unions of filters are
k-way merges of these lists and what a filter removes after others is a difference; the shorter list is searched in the longer one, each search going on
from the place of the last. Sizes are summed over the ranges (``merged_sizes``) and spread over all orders of the filters (``interactions``).

Scale: the rows that move are a doc_id, a part, a digest and some bits, never a text. Whether a row is the first of its text is found by a join on (digest,
doc_id), so copies of one text are dealt over many tasks; a part of any size is cut into many ranges; a task sums its ranges before it sends them.

Defined results: a null text is the empty text and a null source the part ``''``; rows are documents, so repeated rows each count, and neither fails E on the
other's account; a row without doc_id never fails E, makes no other row fail E and has no label; labels that
repeat a doc_id count if any of them says 1; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, bound_batches

FILTERS = "ABCDE"
LISTS = [*FILTERS, "good", "toxic"]
LIST_SCHEMA = pa.schema([("part", pa.string()), ("ids", pa.list_(pa.int64())), *[(x, pa.list_(pa.int32())) for x in LISTS]])
LIST_DDL = "part string, ids array<long>, " + ", ".join(f"{x} array<int>" for x in LISTS)
SIZES = ["removed", "reached", "good_lost", "toxic_lost"]
SIZE_SCHEMA = pa.schema([("part", pa.string()), ("filter", pa.int32()), ("before", pa.int32()), *[(x, pa.int64()) for x in SIZES]])
SIZE_DDL = "part string, filter int, before int, " + ", ".join(f"{x} long" for x in SIZES)
#: The filter number of the rows that hold a part's documents in ``reached``.
EVERY = -1


def failures(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``part``, ``doc_id``, ``digest`` and ``bits`` (one for each of LISTS) of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    n = F.size(words).cast("long")
    told = [
        n < 50,
        F.size(F.array_distinct(words)).cast("long") * 100 < n * 65,
        F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") * 100 > F.length(text).cast("long") * 5,
        text.rlike("[#$%&*|]"),
    ]
    bits = sum((F.when(t, 1 << i).otherwise(0) for i, t in enumerate(told)), F.lit(0))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = alias_free(docs, "doc_id", "text", "source").select(part, F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest"), bits.alias("bits"))
    rows = scratch.keep(rows, "rows")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = alias_free(labels, "doc_id", "quality", "toxic").where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    marks = marks.agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = rows.join(firsts, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    late = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), 1 << 4).otherwise(0)
    labelled = F.coalesce(F.col("good"), F.lit(0)) * (1 << 5) + F.coalesce(F.col("toxic"), F.lit(0)) * (1 << 6)
    return joined.select("part", "doc_id", "digest", (F.col("bits") + late + labelled).cast("int").alias("bits"))


def posting_lists(failed: DataFrame) -> DataFrame:
    """One row per id range of a part: its ``ids`` in order, and per filter and label the ascending row numbers (from 0) on its list."""
    order = ["part", "doc_id", "digest"]
    return failed.repartitionByRange(*order).sortWithinPartitions(*order).select("part", "doc_id", "bits").mapInArrow(cut_ranges, LIST_DDL)


def cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range is what one Arrow batch (``ARROW_ROWS`` rows at most) holds of a part."""
    for batch in batches:
        codes = batch.column("part").dictionary_encode()
        part, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
        bits = batch.column("bits").to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(np.diff(part, prepend=-1))
        for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(part)]):
            lists = [np.flatnonzero(bits[lo:hi] & (1 << i)).astype(np.int32) for i in range(len(LISTS))]
            ids = pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), batch.column("doc_id").slice(lo, hi - lo))
            yield pa.RecordBatch.from_arrays([pa.array([names[part[lo]]]), ids, *[pa.array([x], pa.list_(pa.int32())) for x in lists]], schema=LIST_SCHEMA)


def places(short: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the members of one ascending list stand in another, and whether they are there. NumPy's search of ascending keys starts each at the place of the last."""
    at = np.searchsorted(long, short)
    return at, np.append(long, -1)[at] == short


def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at, there = places(short, long)
    return np.insert(long, at[~there], short[~there])


def difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Members of a that are not in b; the shorter list is searched in the longer."""
    if len(a) <= len(b):
        return a[~places(a, b)[1]]
    at, there = places(b, a)
    return np.delete(a, at[there])


def common(a: np.ndarray, b: np.ndarray) -> int:
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    return int(places(short, long)[1].sum())


def sizes_of(lists: list[np.ndarray]) -> np.ndarray:
    """[filter, set of filters before it, SIZES] of one range; sets that hold the filter stay 0."""
    n, good, toxic = len(FILTERS), lists[-2], lists[-1]
    unions = [np.empty(0, np.int32)]
    for s in range(1, 1 << n):
        lowest = (s & -s).bit_length() - 1
        unions.append(union(unions[s & (s - 1)], lists[lowest]))
    out = np.zeros((n, 1 << n, len(SIZES)), np.int64)
    for f in range(n):
        for s in range(1 << n):
            if not s >> f & 1:
                left = difference(lists[f], unions[s])
                out[f, s] = len(left), len(unions[s | 1 << f]), common(left, good), common(left, toxic)
    return out


def merged_sizes(lists: DataFrame) -> DataFrame:
    """Per part, filter and set of filters before it (``before``, a bit each): what it removes then, of it good and toxic, and the
    size of the union; the rows of filter ``EVERY`` hold the part's documents."""
    summed = lists.select("part", F.size("ids").alias("n"), *LISTS).mapInArrow(sum_ranges, SIZE_DDL)
    return summed.groupBy("part", "filter", "before").agg(*[F.sum(x).alias(x) for x in SIZES])


def sum_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, held, n = None, None, 0

    def rows() -> pa.RecordBatch:
        f, s = np.nonzero(held.any(axis=2))
        at = [np.append(f, EVERY), np.append(s, 0)]
        sums = np.vstack([held[f, s], [0, n, 0, 0]])
        return pa.RecordBatch.from_arrays([pa.array([part] * len(sums), pa.string()), *[pa.array(x, pa.int32()) for x in at], *[pa.array(sums[:, k], pa.int64()) for k in range(len(SIZES))]], schema=SIZE_SCHEMA)

    for batch in batches:
        for i in range(batch.num_rows):
            name = batch.column("part")[i].as_py()
            if name != part:
                if part is not None:
                    yield rows()
                part, held, n = name, np.zeros((len(FILTERS), 1 << len(FILTERS), len(SIZES)), np.int64), 0
            held += sizes_of([batch.column(x)[i].values.to_numpy(zero_copy_only=False) for x in LISTS])
            n += batch.column("n")[i].as_py()
    if part is not None:
        yield rows()


def orders() -> list[tuple[str, int, int, int]]:
    """Every order of the filters, step by step: order, step from 1, filter, filters before it."""
    return [("".join(FILTERS[f] for f in o), k + 1, o[k], sum(1 << f for f in o[:k])) for o in permutations(range(len(FILTERS))) for k in range(len(o))]


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "filter_audit")
    sizes = scratch.keep(merged_sizes(posting_lists(failures(docs, labels, scratch))), "sizes")
    n = len(FILTERS)
    steps = spark.createDataFrame(orders(), "filter_order string, step int, filter int, before int")
    # a part has one row per filter here, then one per order and step: its rows are a constant number
    before = F.bit_count("before").cast("int")
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), before + 1)
    others = F.expr(f"{(1 << n) - 1} - shiftleft(1, filter)")
    alone = sizes.where(f"filter <> {EVERY}").groupBy("part", "filter").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    parts = sizes.where(f"filter = {EVERY}").select("part", F.col("reached").alias("documents"))
    grid = parts.select("part", "documents", F.explode(F.array(*[F.lit(f) for f in range(n)])).alias("filter")).join(F.broadcast(steps), "filter")
    got = grid.join(sizes.where(f"filter <> {EVERY}"), ["part", "filter", "before"], "left").join(alone, ["part", "filter"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return got.select(
        "part", "filter_order", "step", (F.col("documents") - zero("reached")).alias("kept"), zero("removed").alias("removed"), (zero("fails") - zero("removed")).alias("redundant"),
        zero("unique_fails").alias("unique_fails"), zero("good_lost").alias("good_lost"), zero("toxic_lost").alias("toxic_lost"), zero("shapley").alias("shapley"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT coalesce(source, '') AS part, doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
l AS (SELECT doc_id, max((quality = 1)::int) AS good, max((toxic = 1)::int) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(w) < 50)::int + 2 * (100 * len(list_distinct(w)) < 65 * len(w))::int + 4 * (100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 5 * length(text))::int
  + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > least, false)::int AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
  FROM d JOIN firsts USING (text) LEFT JOIN l USING (doc_id)),
p AS (SELECT part, mask, count(*) AS c, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest([0, 1, 2, 3, 4]) AS f),
o AS (SELECT [a.f, b.f, c.f, d.f, e.f] AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT array_to_string(list_transform(o, lambda x: substr('ABCDE', x + 1, 1)), '') AS filter_order, k AS step, o[k] AS f, coalesce(list_sum(list_transform(o[1:k-1], lambda x: 1 << x)), 0)::int AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN mask & (before | (1 << f)) = 0 THEN c ELSE 0 END) AS kept,
  sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN c ELSE 0 END) AS removed, sum(CASE WHEN mask & before > 0 AND mask & (1 << f) > 0 THEN c ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = 1 << f THEN c ELSE 0 END) AS unique_fails, sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & before = 0 AND mask & (1 << f) > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM p, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::int AS step, kept::bigint AS kept, removed::bigint AS removed, redundant::bigint AS redundant, unique_fails::bigint AS unique_fails,
  good_lost::bigint AS good_lost, toxic_lost::bigint AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::bigint AS shapley FROM r
"""
