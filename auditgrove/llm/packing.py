"""Best-fit packing of documents into fixed-length sequences, in bulk-synchronous sweeps.

Documents longer than a sequence are cut into full pieces and a rest; nothing else is cut. Pieces of one length are
interchangeable, so they are range-sorted and run-length encoded: whatever the corpus, the sweeps see at most
``capacity`` classes of pieces and of gaps. A superstep sweeps the sizes downwards once, keeping the gaps met so
far on a stack; every piece class takes its successor, the smallest gap that holds it, and conflicts are resolved by rank: the i-th piece of a class goes to
the i-th sequence of the gap class, the pieces beyond that to the next larger gaps. Then the gaps are updated and the sweep repeats. New sequences are opened only for pieces that no gap can hold,
as many as those pieces need at least. Long pieces (over an eighth of a sequence) are placed before short ones.

The result is a table of rank intervals. The rows themselves never meet in one task: each gets its rank within its length from
counts per (input block, length) and finds its place in the intervals, whose number depends on the capacity only.

Defined results: a null or empty text is its end id alone; repeated rows are packed each; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, bound_batches, blocks, emit, strings
from auditgrove.llm.tokens import default_path, encoder

CAPACITY, END_ID = 4096, 1
PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("block", pa.int64()), ("local_rank", pa.int64())]
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, block long, local_rank long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``local_rank`` counts the pieces of its length within the input block (task)."""
    bound_batches(docs.sparkSession)
    schema = pa.schema(PIECE_FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches):
        own, block, met = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for table in blocks(batches, "text"):
            flat, first = own.encode(strings(table, "text"), end)
            rows = defaultdict(list)
            for doc_id, lo, hi in zip(table.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist()):
                for piece, at in enumerate(range(lo, hi, capacity)):
                    ids = flat[at : min(hi, at + capacity)]
                    n = len(ids)
                    for c, v in zip(schema.names, (doc_id, piece, at - lo, n, zlib.crc32(ids.astype("<u4").tobytes()), block, met[n])):
                        rows[c].append(v)
                    if with_ids:
                        rows["ids"].append(ids)
                    met[n] += 1
            if rows:
                yield emit(rows, schema)
        own.clear()  # the worker lives on, for other work

    source = alias_free(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, PIECE_DDL + (", ids array<int>" if with_ids else ""))


def sweep(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rank intervals (length, first rank, pieces, per sequence, first sequence, offset) that place all pieces.

    The pieces of ranks first..first+pieces-1 of a length go ``per sequence`` each to consecutive sequences.
    """
    out, gaps, opened = [], defaultdict(list), 0  # gaps: size -> [first sequence, number]
    rank = dict.fromkeys(counts, 0)
    for lo, hi in ((capacity // 8 + 1, capacity), (1, capacity // 8)):
        left = {s: n for s, n in counts.items() if lo <= s <= hi and n}
        while left:
            widest = max((g for g in gaps if gaps[g]), default=0)
            unfit = {s: n for s, n in left.items() if s > widest}
            if unfit:
                alone = sum(n for s, n in unfit.items() if 2 * s > capacity)
                new = max(alone, -(-sum(s * n for s, n in unfit.items()) // capacity))
                gaps[capacity].append([opened, new])
                opened += new
            stack, after = [], defaultdict(list)
            for size in sorted({*left, *gaps}, reverse=True):
                stack += [[size, *run] for run in gaps.pop(size, ())]
                n = left.get(size, 0)
                while n and stack:
                    gap, sequence, number = stack[-1]
                    each = min(gap // size, n)
                    taken = min(number, n // each)
                    out.append((size, rank[size], taken * each, each, sequence, capacity - gap))
                    rank[size] += taken * each
                    n -= taken * each
                    if gap > each * size:
                        after[gap - each * size].append([sequence, taken])
                    if taken == number:
                        stack.pop()
                    else:
                        stack[-1][1:] = [sequence + taken, number - taken]
                if n:
                    left[size] = n
                else:
                    left.pop(size, None)
            for gap, sequence, number in stack:
                after[gap].append([sequence, number])
            gaps = after
    return out


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every piece with its ``sequence_id`` and ``offset``; with ``with_ids`` also its token ids."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    found = scratch.keep(pieces(docs, path or default_path(), capacity, end, with_ids), "pieces")
    per_block = found.groupBy("block", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    base = scratch.keep(per_block.withColumn("base", F.coalesce(before, F.lit(0))), "ranks")

    def superstep(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = sweep({int(s): int(n) for s, n in zip(pdf["length"], pdf["n"])}, capacity)
        return pd.DataFrame(rows, columns=["length", "first", "n", "each", "sequence", "offset"], dtype="int64")

    lengths = base.groupBy("length").agg(F.sum("n").alias("n"))  # at most `capacity` rows
    intervals = lengths.groupBy((F.col("length") * 0).alias("all")).applyInPandas(superstep, "length long, first long, n long, each long, sequence long, offset long")
    places = defaultdict(list)
    for r in scratch.keep(intervals, "intervals").collect():
        places[r["length"]].append((r["first"], r["each"], r["sequence"], r["offset"]))
    for rows in places.values():
        rows.sort()
    shared = spark.sparkContext.broadcast(dict(places))
    # `base` has a row per input block and length: it grows with the data and is merged, never broadcast
    ranked = found.join(base.drop("n").hint("merge"), ["block", "length"]).withColumn("rank", F.col("base") + F.col("local_rank"))

    def place(batches):
        for batch in batches:
            sequence, offset = [], []
            for length, rank in zip(batch.column("length").to_pylist(), batch.column("rank").to_pylist()):
                rows = shared.value[length]
                first, each, at, skip = rows[bisect_right(rows, (rank, 1 << 62)) - 1]
                sequence.append(at + (rank - first) // each)
                offset.append(skip + (rank - first) % each * length)
            keep = batch.select([c for c in batch.schema.names if c != "rank"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*keep.schema.names, "sequence_id", "offset"])

    columns = [c for c in found.columns if c not in ("block", "local_rank")]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema if f.name in columns)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{ddl}, sequence_id long, offset long")
