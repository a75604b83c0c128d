"""Benchmark decontamination with an FM-index per training shard.

Each task cuts its rows into shards and indexes every shard: words become benchmark vocabulary ids, runs of such words that are
long enough to hold a window form the shard's string (a word outside the vocabulary, and a run shorter than every window,
cannot lie in an occurrence), the suffixes of that string are sorted, and the Burrows-Wheeler transform goes into a wavelet matrix. All test
windows are searched backward at once through wavelet ranks; occurrences are located by stepping to the nearest
sampled suffix position, and overlapping occurrences are merged into removal spans.

Spark cuts the items into distinct windows and deals these into blocks of about ``BENCH_BYTES`` of window text. One block at a time goes to the
driver, is broadcast as packed arrays, searched in one pass over the documents and released, so neither driver nor tasks hold more than one block.

Defined results: null and empty texts have no words and are never hit; items without words have no window; items with the same
item_id are one item for reporting; an item without item_id is found, but not named among the items; every row keeps its own spans, so repeated rows
get equal results and rows that share a doc_id, or have none, do not mix; an empty benchmark hits nothing; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, flat, strings

WINDOW, SAMPLE, BENCH_BYTES = 10, 8, 32 << 20
#: Every byte that no word holds becomes a space, A-Z lower-cased; words are then split at spaces.
BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
FOUND = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
FOUND_DDL = "row long, doc_id long, n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(BYTES).split()


class Windows:
    """Vocabulary and windows of one block, as arrays: ``table`` holds word ids aligned to the right (0 is no word), ``owner`` the
    item codes of all windows in turn, ``owner_ends`` where each window's end."""

    def __init__(self, block: pa.Table):
        words = pc.split_pattern(flat(block.column("window"), pa.string()), " ")
        coded = words.flatten().dictionary_encode()
        self.ids = {w.encode(): i + 1 for i, w in enumerate(coded.dictionary.to_pylist())}
        self.lengths = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.table = np.zeros((len(self.lengths), WINDOW), np.int32)
        row = np.repeat(np.arange(len(self.lengths)), self.lengths)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.table[row, WINDOW - self.lengths[row] + place] = coded.indices.to_numpy(zero_copy_only=False) + 1
        self.shortest = int(self.lengths.min()) if len(self.lengths) else 0
        items = flat(block.column("items"), pa.list_(pa.string()))
        owners = items.flatten().dictionary_encode()
        self.items = owners.dictionary.to_pylist()
        self.owner = owners.indices.to_numpy(zero_copy_only=False)
        self.owner_ends = np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False)).astype(np.int64)

    def items_of(self, windows: np.ndarray) -> list[str]:
        first = np.where(windows > 0, self.owner_ends[windows - 1], 0)
        codes = {c for lo, hi in zip(first.tolist(), self.owner_ends[windows].tolist()) for c in self.owner[lo:hi].tolist()}
        return sorted(self.items[c] for c in codes)


class FMIndex:
    """Index of a string over 1..sigma in which 0 separates runs; ``run_start`` marks the first symbol of each run."""

    def __init__(self, text: np.ndarray, run_start: np.ndarray):
        n = len(text)
        order = suffix_order(text)
        bwt = text[order - 1]
        top = int(text.max(initial=0)) + 1
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))  # symbols smaller than c
        self.levels, symbols = [], bwt
        self.bits = max(1, int(top).bit_length())
        for level in range(self.bits - 1, -1, -1):
            ones = (symbols >> level) & 1
            rank = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
            self.levels.append((rank, n - int(rank[-1])))
            symbols = np.concatenate((symbols[ones == 0], symbols[ones == 1]))
        self.bwt, self.order = bwt, order
        sampled = (order % SAMPLE == 0) | run_start[order]
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]
        del self.order

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before position ``upto`` of the transform, by wavelet ranks."""
        lo, at = np.zeros_like(upto), upto
        for level, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels):
            bit = (symbol >> level) & 1
            lo = np.where(bit == 1, zeros + ones[lo], lo - ones[lo])
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return at - lo

    def search(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row interval of every pattern (right-aligned, 0 before the first symbol)."""
        lo, hi = np.zeros(len(table), np.int64), np.full(len(table), len(self.bwt), np.int64)
        for j in range(table.shape[1] - 1, -1, -1):
            c = table[:, j]
            live = np.flatnonzero((c > 0) & (hi > lo))
            if not len(live):
                continue
            known = np.minimum(c[live], len(self.before) - 2)
            absent = known != c[live]
            lo[live] = self.before[known] + self.rank(known, lo[live])
            hi[live] = np.where(absent, lo[live], self.before[known] + self.rank(known, hi[live]))
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.sampled[rows[open_]]
            hit = open_[done]
            out[hit] = self.samples[self.sample_rank[rows[hit]]] + steps[hit]
            open_ = open_[~done]
            c = self.bwt[rows[open_]]
            rows[open_] = self.before[c] + self.rank(c, rows[open_])
            steps[open_] += 1
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; every separator is distinct, so rounds end with the longest run."""
    n = len(text)
    key = text.astype(np.int64)
    gaps = np.flatnonzero(text == 0)
    rank = key + len(gaps)
    rank[gaps] = np.arange(len(gaps))
    width = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - width] = rank[width:] + 1
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        dense = np.concatenate(([0], np.cumsum(ranked[1:] != ranked[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = dense
        width *= 2
        if dense[-1] == n - 1 or width >= n:
            return order


def shard_hits(texts: list[str], windows: Windows):
    """Of each text: number of words, and (window row, first word) of every occurrence."""
    ids = windows.ids.get
    coded, counts = [], []
    for text in texts:
        own = words_of(text)
        counts.append(len(own))
        coded.append(np.fromiter((ids(w, 0) for w in own), dtype=np.int32, count=len(own)))
        coded.append(np.zeros(1, np.int32))
    symbols = np.concatenate(coded) if coded else np.zeros(0, np.int32)
    starts = np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64) + 1)))
    none = np.empty(0, np.int64)
    if not len(windows.lengths) or not len(symbols):
        return counts, (none, none, none)
    inside = np.concatenate(([False], symbols > 0, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, last = edge[::2], edge[1::2]
    long = last - first >= windows.shortest
    first, last = first[long], last[long]
    if not len(first):
        return counts, (none, none, none)
    sizes = last - first + 1  # with the separator behind each run
    new_start = np.cumsum(sizes) - sizes
    source = np.arange(sizes.sum()) - np.repeat(new_start - first, sizes)
    text = symbols[source].astype(np.int64)
    text[new_start + sizes - 1] = 0
    run_start = np.zeros(len(text), bool)
    run_start[new_start] = True
    index = FMIndex(text, run_start)
    lo, hi = index.search(windows.table.astype(np.int64))
    found = np.flatnonzero(hi > lo)
    n = (hi - lo)[found]
    rows = np.repeat(lo[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = source[index.locate(rows)]
    window = np.repeat(found, n)
    doc = np.searchsorted(starts, at, side="right") - 1
    return counts, (doc, window, at - starts[doc])


def merge(first: np.ndarray, last: np.ndarray) -> tuple[list[int], list[int]]:
    """Union of half-open spans as sorted disjoint spans."""
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order])
    new = np.concatenate(([True], first[1:] > last[:-1]))
    ends = last[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(last) - 1]))]
    return first[new].tolist(), ends.tolist()


def window_table(bench: DataFrame, scratch: Scratch, limit: int) -> tuple[DataFrame, int]:
    """Distinct windows with the items that hold them and their block, written to scratch, and the number of blocks."""
    items = alias_free(bench, "item_id", "text").where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string"))

    def run(batches):
        for table in blocks(batches, "text"):
            ids, windows = [], []
            for item_id, text in zip(table.column("item_id").to_pylist(), strings(table, "text").to_pylist()):
                own = words_of(text)
                for i in range(max(1, len(own) - WINDOW + 1) if own else 0):
                    ids.append(item_id)
                    windows.append(b" ".join(own[i : i + WINDOW]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(windows, pa.string())], names=["item_id", "window"])

    bound_batches(bench.sparkSession)
    cut = items.mapInArrow(run, "item_id string, window string")
    distinct = scratch.keep(cut.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    size = F.octet_length("window") + F.octet_length(F.array_join("items", ","))
    total = distinct.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    n = max(1, -(-total // limit))
    return distinct.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(n))), n


def blocks_of_windows(bench: DataFrame, scratch: Scratch, limit: int):
    """The blocks one after the other; the caller is done with one before the next is collected."""
    table, n = window_table(bench, scratch, limit)
    for i in range(n):
        yield n, Windows(table.where(F.col("block") == i).select("window", "items").toArrow())


def find_spans(docs: DataFrame, bench: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id, n_words, removal spans (first word, word after the last) and the items found, of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    bound_batches(spark)
    source = alias_free(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    passes = blocks_of_windows(bench, scratch, limit or BENCH_BYTES)
    n, first = next(passes)
    if n == 1:
        return one_pass(source.withColumn("row", F.lit(0).cast("long")), spark.sparkContext.broadcast(first), every=True).drop("row")
    keyed = scratch.keep(source.withColumn("row", F.monotonically_increasing_id()), "rows")
    return spans_by_row(keyed, first, passes, scratch, every=True).drop("row")


def one_pass(rows: DataFrame, shared, every: bool) -> DataFrame:
    """What one block finds in each row; without ``every`` only the rows with a hit."""

    def run(batches):
        for table in blocks(batches, "text"):
            got = spans_of(strings(table, "text").to_pylist(), shared.value)
            out = emit({"row": table.column("row"), "doc_id": table.column("doc_id")} | got, FOUND)
            yield out if every else out.filter(pa.array([bool(s) for s in got["starts"]], pa.bool_()))

    return rows.select("row", "doc_id", "text").mapInArrow(run, FOUND_DDL)


def spans_by_row(keyed: DataFrame, first: Windows, rest, scratch: Scratch, every: bool) -> DataFrame:
    """The spans of all blocks, merged by the key ``row``, which was written with the rows and so is the same in each pass."""
    found, windows = None, first
    while windows is not None:
        shared = keyed.sparkSession.sparkContext.broadcast(windows)
        own = scratch.keep(one_pass(keyed, shared, every and found is None), "found")
        shared.destroy()  # this block is written: its windows are given up before the next is collected
        found = own if found is None else found.unionByName(own)
        windows = next(rest, (0, None))[1]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("starts", "ends", "items")]
    together = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)
    together = together.withColumn("items", F.array_sort(F.array_distinct("items"))).select(*FOUND.names)

    def run(batches):
        for batch in batches:
            spans = [merge(np.array(s), np.array(e)) if s else ([], []) for s, e in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist())]
            yield emit({c: batch.column(c) for c in ("row", "doc_id", "n_words", "items")} | {"starts": [x[0] for x in spans], "ends": [x[1] for x in spans]}, FOUND)

    return together.mapInArrow(run, FOUND_DDL)


def spans_of(texts: list[str], windows: Windows) -> dict[str, list]:
    counts, (doc, window, at) = shard_hits(texts, windows)
    out = {"n_words": counts, "starts": [[] for _ in texts], "ends": [[] for _ in texts], "items": [[] for _ in texts]}
    order = np.argsort(doc, kind="stable")
    doc, window, at = doc[order], window[order], at[order]
    for own in np.split(np.arange(len(doc)), np.flatnonzero(doc[1:] != doc[:-1]) + 1) if len(doc) else []:
        d = int(doc[own[0]])
        out["starts"][d], out["ends"][d] = merge(at[own], at[own] + windows.lengths[window[own]])
        out["items"][d] = windows.items_of(np.unique(window[own]))
    return out


def contamination(docs: DataFrame, bench: DataFrame, limit: int | None = None) -> DataFrame:
    """Report per document: words, words hit, items found and their digest."""
    found = find_spans(docs, bench, limit)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "starts", "ends")


def cut_spans(text: str, starts: list[int], ends: list[int]) -> str:
    """The text without the words of the spans and what stands between them; what is left is joined by one space."""
    raw = text.encode("utf-8", "surrogatepass")
    flags = np.frombuffer(raw.translate(BYTES), np.uint8) != 32
    edge = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    parts, at = [], 0
    for s, e in zip(starts, ends):
        parts.append(raw[at : first[s]])
        at = last[e - 1]
    parts.append(raw[at:])
    return " ".join(p.decode("utf-8", "surrogatepass").strip() for p in parts).strip()


def remove_spans(docs: DataFrame, bench: DataFrame, limit: int | None = None) -> DataFrame:
    """The documents with every span removed from their texts and n_chars counted anew; unhit rows stay as they are.

    A document of which no word is left goes. With a benchmark of one block the spans are found and cut in the same
    task, without a shuffle; with more blocks the rows are written with a key each, the spans found block by block and
    joined by that key, so rows that share a doc_id, or have none, get their own.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "decontam")
    bound_batches(spark)
    passes = blocks_of_windows(bench, scratch, limit or BENCH_BYTES)
    n, first = next(passes)
    shared = spark.sparkContext.broadcast(first if n == 1 else None)
    source = docs
    if n > 1:
        keyed = scratch.keep(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("row")), "rows")
        slim = keyed.select("row", F.lit(None).cast("long").alias("doc_id"), F.col("whole.text").cast("string").alias("text"))
        spans = scratch.keep(spans_by_row(slim, first, passes, scratch, every=False).select("row", "starts", "ends"), "spans")
        free = "_" * max(len(c) for c in docs.columns)  # no column of the rows has these names
        source = keyed.join(spans, "row", "left").select("whole.*", F.col("starts").alias(f"starts{free}"), F.col("ends").alias(f"ends{free}"))
    schema = pa.schema([(f.name, kind) for f, kind in zip(docs.schema, arrow_types(docs))])

    def run(batches):
        for table in blocks(batches, "text"):
            texts = strings(table, "text").to_pylist()
            if shared.value is None:
                starts, ends = (table.column(len(schema) + i).to_pylist() for i in (0, 1))
            else:
                got = spans_of(texts, shared.value)
                starts, ends = got["starts"], got["ends"]
            keep, changed = np.ones(len(texts), bool), table.column("text").to_pylist()
            sizes = table.column("n_chars").to_pylist() if "n_chars" in schema.names else None
            for i, s in enumerate(starts):
                if s:
                    changed[i] = cut_spans(texts[i], s, ends[i])
                    keep[i] = bool(words_of(changed[i]))
                    if sizes is not None:
                        sizes[i] = len(changed[i])
            cols = {c: table.column(i) for i, c in enumerate(schema.names)} | {"text": changed} | ({"n_chars": sizes} if sizes is not None else {})
            yield emit(cols, schema).filter(pa.array(keep))

    return source.mapInArrow(run, docs.schema)


def arrow_types(df: DataFrame) -> list[pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_schema

    return [f.type for f in to_arrow_schema(df.schema)]
