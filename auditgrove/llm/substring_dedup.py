"""Removal of passages that an earlier document has as well, by level-wise doubling.

A window is ``window`` consecutive words of one document; a word goes if it is covered by a window whose words also start in a document with a smaller
doc_id. Windows are found level by level: at the first length (``window`` halved until it is at most ``FIRST``) every window is counted; only windows repeated
there are extended to twice that length (at the last level to ``window``, by two overlapping halves), until that length is reached or no candidate survives.

* Exact copies first: rows of one text are one class, and only the class's smallest doc_id takes part. A later copy loses all its words, or, with fewer words than a
  window, none. Texts that may have copies are told by a bitmap of digests; only these move.
* A level below the last sends hashes alone: 32 bits each, packed per slot of the hash space, every window of a task once. A slot holds about ``SLOT``
  windows whatever the skew, as a window that stands everywhere is one entry per task. Repeated hashes become a bitmap of at most ``MOST_BITS`` bits, which is
  broadcast. A bitmap only lets too much through, so results do not depend on its size; when it fills, the next level moves more rows.
* At the last level a task settles what it can: of equal windows in one block of text only those of the smallest doc_id are still open. Open windows meet by a 128-bit hash, so a
  window has at most one row per block there, and the smallest doc_id wins.
* Texts that lose words move once, to their spans.

Defined results: null and empty texts have no words; a text shorter than a window loses nothing; copies that share their doc_id all stay, as none is smaller;
a row without doc_id comes after all others, and among such rows none is smaller; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, mix, rolling, split_words, strings

WINDOW, FIRST = 13, 8
#: Text of one block inside a task; windows of one slot of the hash space; bytes of text a word takes at least, for the number of slots.
BLOCK, SLOT, WORD_BYTES = 12 << 20, 1 << 19, 6
#: Bits of a bitmap: per entry, at least, at most (128 MB), and at most for digests of texts, whose cells Spark aggregates.
ENTRY_BITS, LEAST_BITS, MOST_BITS, MOST_TEXT_BITS = 8, 20, 30, 26
NO_ID = (1 << 63) - 1
SEEN = pa.schema([("slot", pa.int32()), ("more", pa.binary()), ("once", pa.binary())])
SLOTS = pa.schema([("slot", pa.int32()), ("n", pa.int64()), ("found", pa.binary())])
OPEN = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("id", pa.int64()), ("d", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("others", pa.binary())])
OPEN_DDL = "h1 long, h2 long, id long, d long, start int, stop int, others binary"
LEFT = pa.schema([("id", pa.int64()), ("d", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def levels(window: int) -> list[int]:
    """Lengths from the first to ``window``, each at most twice the one before."""
    found = [window]
    while found[0] > FIRST:
        found.insert(0, (found[0] + 1) // 2)
    return found


class Bitmap:
    """A set of 64-bit hashes by their leading bits; absent members may be reported, present ones always are."""

    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.bits, self.cells = bits, np.zeros(1 << (bits - 3), np.uint8) if cells is None else cells

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - self.bits)
        return (self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bits_for(n: int, least: int = LEAST_BITS) -> int:
    return min(MOST_BITS, max(least, int(n * ENTRY_BITS).bit_length()))


def bitmap_of(hashes: DataFrame, n: int) -> Bitmap:
    """Bitmap of the long column ``h``, of which there are about n; the driver gets a number of cells that the bits bound."""
    bits = min(MOST_TEXT_BITS, bits_for(n))
    at = F.shiftrightunsigned("h", 64 - bits)
    cells = hashes.groupBy(F.shiftright(at, 5).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[cells["cell"].to_numpy()] = cells["set"].to_numpy().astype(np.uint32)
    return Bitmap(bits, out.view(np.uint8))


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """Two 64-bit hashes of each word."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([digest(w) for w in dictionary.to_pylist()]), np.uint64).reshape(-1, 2)


class Words:
    """The words of one block of texts: their hashes and rows."""

    def __init__(self, block: pa.Table):
        self.sizes, codes, dictionary = split_words(strings(block, "text"), False)
        self.codes, self.hashes = codes, word_hashes(dictionary)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.ids = block.column("id").to_numpy()

    def windows(self, length: int) -> np.ndarray:
        """Places at which a window of that length lies within one text."""
        n = max(len(self.owner) - length + 1, 0)
        return np.flatnonzero(self.owner[:n] == self.owner[length - 1 :])

    def hashed(self, length: int, half: int = 0) -> np.ndarray:
        return rolling(self.hashes[:, half][self.codes], length)

    def candidates(self, length: int, shorter: int, repeated: Bitmap | None) -> np.ndarray:
        """Windows whose halves, two windows of the level before, are both repeated."""
        at = self.windows(length)
        if repeated is not None and len(at):
            live = repeated.has(self.hashed(shorter))
            at = at[live[at] & live[at + length - shorter]]
        return at


def text_blocks(batches: Iterator[pa.RecordBatch], copied: Bitmap) -> Iterator[pa.Table]:
    """Blocks of one text per class: rows whose text may have copies are left to the table that holds each class once."""

    def kept() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = batch.column("alone").to_numpy(zero_copy_only=False) | ~copied.has(batch.column("d").to_numpy().view(np.uint64))
            yield batch if stays.all() else batch.filter(pa.array(stays))

    return blocks(kept(), "text", BLOCK)


def seen(length: int, shorter: int, slot_bits: int, copied: Broadcast, repeated: Broadcast | None) -> Callable:
    """Windows of a task, packed per slot: those that two of its documents hold, and the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, copied.value):
            words = Words(block)
            at = words.candidates(length, shorter, repeated and repeated.value)
            if not len(at):
                continue
            h, ids = words.hashed(length)[at], words.ids[words.owner[at]]
            order = np.argsort(h, kind="stable")
            h, ids = h[order], ids[order]
            begins = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            more = np.minimum.reduceat(ids, begins) < np.maximum.reduceat(ids, begins)
            h = h[begins]
            slot, rest = (h >> np.uint64(64 - slot_bits)).astype(np.int32), (h >> np.uint64(32 - slot_bits)).astype(np.uint32)
            edges = np.flatnonzero(np.diff(slot, prepend=-1)).tolist()
            rows = {"slot": [], "more": [], "once": []}
            for lo, hi in zip(edges, [*edges[1:], len(slot)]):
                rows["slot"].append(int(slot[lo]))
                rows["more"].append(rest[lo:hi][more[lo:hi]].tobytes())
                rows["once"].append(rest[lo:hi][~more[lo:hi]].tobytes())
            yield emit(rows, SEEN)

    return run


def repeated_in_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot: the hashes that two documents hold."""
    slot, held = None, []

    def found() -> pa.RecordBatch:
        rest = np.sort(np.frombuffer(b"".join(held), np.uint32))
        twice = np.unique(rest[1:][rest[1:] == rest[:-1]])
        return emit({"slot": [slot], "n": [len(twice)], "found": [twice.tobytes()]}, SLOTS)

    for batch in batches:
        for s, more, once in zip(*(batch.column(c).to_pylist() for c in ("slot", "more", "once"))):
            if s != slot:
                if slot is not None:
                    yield found()
                slot, held = s, []
            held += (more, more, once)
    if slot is not None:
        yield found()


def level(texts: DataFrame, make: Callable, slot_bits: int, scratch: Scratch) -> Bitmap | None:
    """The bitmap of the windows that one level finds repeated; None if there are none."""
    dealt = texts.mapInArrow(make, "slot int, more binary, once binary").repartition("slot").sortWithinPartitions("slot")
    slots = scratch.keep(dealt.mapInArrow(repeated_in_slots, "slot int, n long, found binary").where("n > 0"), "repeated")
    n = slots.agg(F.sum("n")).first()[0] or 0
    bits = bits_for(n, max(LEAST_BITS, slot_bits + 3))
    width = 1 << (bits - slot_bits)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slot, found in zip(batch.column("slot").to_pylist(), batch.column("found").to_pylist()):
                marks = np.zeros(width, np.uint8)
                marks[np.frombuffer(found, np.uint32) >> np.uint32(32 - bits + slot_bits)] = 1
                yield emit({"slot": [slot], "n": [0], "found": [np.packbits(marks, bitorder="little").tobytes()]}, SLOTS)

    out = Bitmap(bits)
    if n:
        got = slots.mapInArrow(cells, "slot int, n long, found binary").select("slot", "found").toArrow()
        for slot, found in zip(got["slot"].to_pylist(), got["found"].to_pylist()):
            out.cells[slot * width >> 3 : (slot + 1) * width >> 3] = np.frombuffer(found, np.uint8)
    scratch.drop(slots)
    return out if n else None


def open_windows(length: int, shorter: int, copied: Broadcast, repeated: Broadcast | None) -> Callable:
    """Windows of the last level: runs that are late within their block (``stop`` is given), and the open ones, a row for each text that holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, copied.value):
            words = Words(block)
            at = words.candidates(length, shorter, repeated and repeated.value)
            if not len(at):
                continue
            h1, h2, row = words.hashed(length)[at], words.hashed(length, 1)[at], words.owner[at]
            order = np.lexsort((at, row, words.ids[row], h2, h1))
            at, row, h1, h2 = at[order], row[order], h1[order], h2[order]
            ids, start, d = words.ids[row], (at - words.first[row]).astype(np.int32), block.column("d").to_numpy()
            fresh = np.concatenate(([True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
            late = ids > ids[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
            # open: the first place of a window in a text stands for the others there
            lead = ~late & (fresh | np.concatenate(([True], row[1:] != row[:-1])))
            lead_at = np.flatnonzero(lead)
            others = [None] * len(lead_at)
            follow = np.flatnonzero(~late & ~lead)
            if len(follow):
                mine = np.searchsorted(lead_at, follow, side="right") - 1
                cuts = np.flatnonzero(np.diff(mine, prepend=-1)).tolist()
                for lo, hi in zip(cuts, [*cuts[1:], len(mine)]):
                    others[mine[lo]] = start[follow[lo:hi]].tobytes()
            yield emit({"h1": h1[lead].view(np.int64), "h2": h2[lead].view(np.int64), "id": ids[lead], "d": d[row[lead]], "start": start[lead], "stop": pa.nulls(len(lead_at), pa.int32()), "others": pa.array(others, pa.binary())}, OPEN)
            place = np.sort(at[late])
            if len(place):
                heads = np.flatnonzero(np.diff(place, prepend=-2) != 1)
                heads = np.union1d(heads, np.flatnonzero(np.diff(words.owner[place], prepend=-1)))
                row, first, last = words.owner[place[heads]], place[heads], place[np.append(heads[1:], len(place)) - 1]
                first, last = ((x - words.first[row]).astype(np.int32) for x in (first, last))
                own = mix(d[row].view(np.uint64) + first.astype(np.uint64))  # groups of their own, dealt evenly
                yield emit({"h1": d[row], "h2": own.view(np.int64), "id": words.ids[row], "d": d[row], "start": first, "stop": last, "others": pa.nulls(len(row), pa.binary())}, OPEN)

    return run


def with_bit(marked: Broadcast, without: Broadcast | None = None) -> Callable:
    """Rows whose digest has a bit in one bitmap and none in the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d").to_numpy().view(np.uint64)
            yield batch.filter(pa.array(marked.value.has(d) & (~without.value.has(d) if without else True)))

    return run


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row's word count and digest as it is. ``bytes.split`` parts at the same six characters as a word."""
    for batch in batches:
        split = [t.split() for t in batch.column("text").cast(pa.binary()).to_pylist()]
        at = batch.schema.get_field_index("text")
        kept = batch.remove_column(at)
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array([len(w) for w in split], pa.int64()), pa.array([sha(w) for w in split])], names=[*kept.schema.names, "n_words", "whole_sha256"])


def cut(window: int) -> Callable:
    """Texts with their late windows: what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {"n_removed": [], "kept_sha256": []}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans")):
                words, spans = text.split(), spans.values
                start, stop = spans.field("start").to_numpy(), spans.field("stop")
                stop = np.where(stop.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(stop, 0).to_numpy(), start)
                rest = np.frombuffer(b"".join(x for x in spans.field("others").to_pylist() if x), np.int32)
                edge = np.zeros(len(words) + 1, np.int64)
                np.add.at(edge, np.concatenate((start, rest)), 1)
                np.add.at(edge, np.concatenate((stop, rest)) + window, -1)
                stays = np.cumsum(edge[:-1]) == 0
                rows["n_removed"].append(int(len(words) - stays.sum()))
                rows["kept_sha256"].append(sha(list(compress(words, stays))))
            yield emit({"id": batch.column("id"), "d": batch.column("d")} | rows, LEFT)

    return run


def late_windows(texts: DataFrame, copied: Broadcast, slot_bits: int, window: int, scratch: Scratch) -> DataFrame | None:
    """``id``, ``d`` and the ``spans`` of window starts of every text that loses words."""
    spark, repeated, shorter = texts.sparkSession, None, 0
    for length in levels(window)[:-1]:
        bitmap = level(texts, seen(length, shorter, slot_bits, copied, repeated), slot_bits, scratch)
        if repeated is not None:
            repeated.unpersist()
        if bitmap is None:
            return None
        repeated, shorter = spark.sparkContext.broadcast(bitmap), length
    rows = texts.mapInArrow(open_windows(window, shorter, copied, repeated), OPEN_DDL)
    rows = rows.withColumn("least", F.min("id").over(Window.partitionBy("h1", "h2"))).where("stop is not null or id > least")
    return scratch.keep(rows.groupBy("id", "d").agg(F.collect_list(F.struct("start", "stop", "others")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: ``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256``, the digest of the words that stay, joined by one space."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "substring_dedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = alias_free(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("d"), F.xxhash64(F.lit(1), "text").alias("e"), "text")
    classes = rows.groupBy("d", "e").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.max(F.octet_length("text")).alias("bytes"))
    classes = scratch.keep(classes, "classes")
    total = classes.agg(F.sum("bytes").alias("bytes"), F.sum((F.col("n") > 1).cast("long")).alias("copied")).first()
    n_slots = (total["bytes"] or 0) // WORD_BYTES // SLOT
    slot_bits = min(20, max(5, int(n_slots).bit_length()))
    copied = spark.sparkContext.broadcast(bitmap_of(classes.where("n > 1").select(F.col("d").alias("h")), total["copied"] or 0))
    firsts = classes.select("d", "e", "id")
    held = rows.mapInArrow(with_bit(copied), rows.schema).dropDuplicates(["id", "d", "e"]).join(firsts, ["id", "d", "e"])
    held = scratch.keep(held.select("id", "d", "text", F.lit(True).alias("alone")), "copied")
    texts = rows.select("id", "d", "text", F.lit(False).alias("alone")).unionByName(held)
    spans = late_windows(texts, copied, slot_bits, window, scratch)
    out = rows.mapInArrow(whole, "doc_id long, id long, d long, e long, n_words long, whole_sha256 string").join(firsts.withColumn("first", F.lit(True)), ["id", "d", "e"], "left")
    if spans is None:
        out = out.withColumn("n_removed", F.lit(0).cast("long")).withColumn("kept_sha256", F.lit(None).cast("string"))
    else:
        losing = spark.sparkContext.broadcast(bitmap_of(spans.select(F.col("d").alias("h")), spans.count()))
        moved = texts.where("not alone").drop("alone")
        moved = moved.mapInArrow(with_bit(losing, copied), moved.schema).unionByName(held.drop("alone"))
        out = out.join(moved.join(spans, ["id", "d"]).mapInArrow(cut(window), "id long, d long, n_removed long, kept_sha256 string"), ["id", "d"], "left")
    again = F.col("first").isNull() & (F.col("n_words") >= window)
    return out.select(
        "doc_id", "n_words",
        F.when(again, F.col("n_words")).when(F.col("first").isNull(), 0).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(again, F.lit(sha([]))).when(F.col("first").isNull(), F.col("whole_sha256")).otherwise(F.coalesce("kept_sha256", "whole_sha256")).alias("kept_sha256"),
    )


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
h AS (SELECT r, doc_id, i, w[i:i + 12] AS k FROM p),
l AS (SELECT k, min(doc_id) AS least FROM h GROUP BY k),
c AS (SELECT DISTINCT r, i + j AS i FROM (SELECT r, i FROM h JOIN l USING (k) WHERE doc_id > least), (SELECT unnest(range(13)) AS j)),
g AS (SELECT r, list(i) AS gone FROM c GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(len(gone), 0)::bigint AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(w, ' ') ELSE array_to_string(list_select(w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), ' ') END) AS kept_sha256
FROM d LEFT JOIN g USING (r)
"""
