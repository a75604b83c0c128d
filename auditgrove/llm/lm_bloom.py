"""Language-model scoring with a log-frequency Bloom filter.

Training counts unigrams, bigrams and trigrams of the training texts (every text ends with an end token; its first token follows a start mark). Bigrams and
trigrams seen twice or more go into one filter: a count c is quantised to level floor(log2 c) + 1, and the filter holds an n-gram once for each level from 1 to its own, so a
probe asks for level 1, 2, ... until one is absent, and a false positive can only raise a count by few steps. With 16 bits an entry and
5 probes 0.14 % of absent n-grams are found. All n-grams are counted, but one seen once is left out of the filter: in a training text it would only repeat the
text itself, and without it passages that the corpus repeats stand out. The
filter is cut into slices by n-gram hash: tasks emit their sorted n-gram hashes as packed arrays, one row a slice in one batch, one task merges a
slice of bounded size and sets its bits.

The model interpolates through the filter: unigrams are exact (the contract's base needs them), and with the mean count of a level
``p2(w | v) = (1 - b) * p1(w) + b * c(v,w) / c(v)`` and ``p(w | u,v) = (1 - a) * p2(w | v) + a * c(u,v,w) / c(u,v)``, or ``p2`` where the filter has no (u,v); the first token
of a text has only ``p2`` after the start mark, of which there are as many as training texts. ``p1(w) = (c(w) + 1) / (N + V + 1)``. The weights are Good-Turing
masses of the training texts: ``b`` is the share of bigrams that were seen twice or more, ``a`` the number of trigrams seen twice or more over that of bigrams. So an
n-gram that the filter leaves out costs a factor 1 - b or 1 - a, however frequent its history is.

Scoring broadcasts the filter and the unigram table only while together they take at most ``BROADCAST_BYTES``. Beyond that, and from ``TEXT_PER_MODEL`` times
that much text without a try, the texts are written as units of hashed tokens, and a unit's n-grams are counted and asked for in one: where a slice is merged, its filter
answers every unit with the levels of the n-grams that the unit sent, in their order, so that nothing but these numbers travels back. Rows between units and slices
grow with the product of their numbers, each some microseconds; bytes grow with the texts.

Defined results: a null or empty text is its end token; repeated rows are scored (and counted) each; with no training text all
counts are 0 and p1 is 1; extra columns are ignored. doc_id null counts as the text "" for the split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, flat, hash_strings, mix, split_words, strings

FOLDS, HELD_OUT = 7, 2
PROBES, BITS_PER_ENTRY, SLICE_BYTES, BROADCAST_BYTES = 5, 16, 16 << 20, 192 << 20
#: Text scored at a time beside the broadcast model.
SCORE_BYTES = 2 << 20
#: Text from which the model is not expected to fit, in parts of what may be broadcast; texts of one unit on the way without broadcast, and of one task there.
TEXT_PER_MODEL, UNIT_BYTES, TASK_BYTES = 8, 8 << 20, 64 << 20
#: Parquet of rows of some MB: without these settings a hundred of them are held before anything is written.
LARGE_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}
#: Slices at most: a slice is a number of whole ranges of the upper 16 bits of a hash.
MOST_SLICES = 1 << 16
#: Count from which the filter holds a bigram or trigram.
LEAST = 2
#: Bound of the weights of bigrams and trigrams, so that no token has probability 0.
MOST_WEIGHT = 0.99
#: Distinct n-grams of a task before it sends them on.
HELD = 1_000_000
END, START = mix(np.array([11, 13], dtype=np.uint64))
MULTIPLIERS = mix(np.arange(1, PROBES + 1, dtype=np.uint64)) | np.uint64(1)
STEP, BITS_48 = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 48) - 1)
COUNTS = pa.schema([("slice", pa.int32()), ("unit", pa.int64()), ("gram", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("seen", pa.binary()), ("again", pa.binary()), ("counts", pa.binary())])
COUNTS_DDL = "slice int, unit long, gram int, low binary, high binary, seen binary, again binary, counts binary"
MERGED = pa.schema([(x, pa.int64()) for x in ("slice", "n", "once", "total", "ends", "size", "mass2", "mass3")] + [(x, pa.binary()) for x in ("hashes", "counts", "bits")])
MERGED_DDL = "slice long, n long, once long, total long, ends long, size long, mass2 long, mass3 long, hashes binary, counts binary, bits binary"
ANSWERS = pa.schema([("unit", pa.int64()), ("gram", pa.int32()), ("slice", pa.int32()), ("values", pa.binary())] + [(x, pa.int64()) for x in ("n", "total", "ends", "mass2", "mass3")])
ANSWERS_DDL = "unit long, gram int, slice int, values binary, n long, total long, ends long, mass2 long, mass3 long"
SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def held_out(doc_ids: list[int | None]) -> np.ndarray:
    return np.array([zlib.crc32(("" if d is None else str(d)).encode()) % FOLDS == HELD_OUT for d in doc_ids], dtype=bool)


class Tokens:
    """Tokens of a block of texts: distinct ones (``known``), the place of each token in them, and n-gram hashes."""

    def __init__(self, known: np.ndarray, place: np.ndarray, counts: np.ndarray):
        self.known, self.place, self.counts = known, place, counts
        self.first = np.cumsum(counts) - counts

    @classmethod
    def of(cls, texts: pa.Array) -> "Tokens":
        counts, codes, words = split_words(texts, lower=True)
        return cls(np.append(hash_strings(words), END), np.insert(codes, np.cumsum(counts), len(words)), counts + 1)

    def earlier(self, values: np.ndarray, start) -> np.ndarray:
        """The value of the token before each; ``start`` at the head of a text."""
        out = np.empty_like(values)
        out[1:] = values[:-1]
        out[self.first] = start
        return out

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """48-bit hashes of the bigram and the trigram that end at each token, and whether it has a trigram."""
        flat = self.known[self.place]
        before = self.earlier(flat, START)
        pair = mix(before * STEP + flat)
        triple = mix(self.earlier(pair, START) * STEP + flat + np.uint64(1))
        inner = np.ones(len(flat), bool)
        inner[self.first] = False
        return pair & BITS_48, triple & BITS_48, inner


def tally(hashes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order and the sum of their counts."""
    if counts is None:
        hashes = np.sort(hashes)
    else:
        order = np.argsort(hashes)
        hashes, counts = hashes[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    if counts is None:
        return hashes[new], np.diff(np.append(new, len(hashes)))
    return hashes[new], np.add.reduceat(counts, new) if len(new) else counts[:0]


def slice_of(hashes: np.ndarray, slices: int, gram: int) -> np.ndarray:
    """Slices, a power of two, are equal ranges of the hash, so sorted hashes come slice by slice."""
    return ((hashes >> np.uint64(32 if gram == 1 else 16)) * np.uint64(slices) >> np.uint64(32)).astype(np.int64)


def slices_of(size: int) -> int:
    """Slices for texts of so many bytes."""
    return min(MOST_SLICES, 1 << max(0, -(-size // SLICE_BYTES) - 1).bit_length())


def cells(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie side by side in data and end at the given bytes."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data).view(np.uint8))])


def uncelled(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and the bytes of each value."""
    own = flat(column, pa.binary())
    if not len(own):
        return np.empty(0, np.uint8), np.empty(0, np.int64)
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1].astype(np.int64)
    return np.frombuffer(own.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest of 1, 4 or 8 bytes."""
    most = int(values.max(initial=0))
    return values.astype(np.uint8 if most < 1 << 8 else np.uint32 if most < 1 << 32 else np.uint64)


def widened(data: np.ndarray, lengths: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Numbers of ``narrow``, n in each value."""
    ends, lengths, n = np.cumsum(lengths)[n > 0], lengths[n > 0], n[n > 0]
    width = lengths // n
    if len(set(width.tolist())) < 2:
        return data.view(f"<u{width[0]}").astype(np.int64) if len(width) else np.empty(0, np.int64)
    return np.concatenate([data[e - size : e].view(f"<u{w}").astype(np.int64) for e, size, w in zip(ends, lengths, width)])


def bit_places(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the bits of rows of n bits each that begin at whole bytes, and where the bytes of each row end."""
    ends = np.cumsum((n + 7) // 8)
    return np.arange(n.sum()) + np.repeat(ends * 8 - (n + 7) // 8 * 8 - np.cumsum(n) + n, n), ends


def flag_cells(flags: np.ndarray, n: np.ndarray) -> pa.Array:
    places, ends = bit_places(n)
    wide = np.zeros(int(ends[-1]) * 8 if len(ends) else 0, np.uint8)
    wide[places] = flags
    return cells(np.packbits(wide), ends)


def unflagged(column: pa.ChunkedArray, n: np.ndarray) -> np.ndarray:
    return np.unpackbits(uncelled(column)[0])[bit_places(n)[0]].astype(bool)


def count_batch(hashes: np.ndarray, counts: np.ndarray, slices: int, gram: int, unit: int | None = None) -> pa.RecordBatch:
    """One row a slice that has some of the distinct sorted hashes: unigram hashes whole, of longer n-grams the lower 32 bits and how many there are of each value of the upper 16.
    Counts are two bits, from 1 and from 2, most being 0 or 1; those from 2 are listed."""
    if gram == 1:
        edge = np.searchsorted(slice_of(hashes, slices, gram), np.arange(slices + 1))
        low = hashes
    else:
        per = np.bincount((hashes >> np.uint64(32)).astype(np.int64), minlength=1 << 16)
        edge = np.concatenate(([0], np.cumsum(per)))[:: (1 << 16) // slices]
        low = hashes.astype(np.uint32)
    own = np.flatnonzero(np.diff(edge))
    ends, n, again = edge[own + 1], np.diff(edge)[own], counts > 1
    more, more_ends = narrow(counts[again]), np.concatenate(([0], np.cumsum(again)))[ends]
    if gram == 1:
        high = cells(np.empty(0, np.uint8), np.zeros(len(own), np.int64))
    else:
        kept = narrow(per.reshape(slices, -1)[own])
        high = cells(kept.ravel(), np.arange(1, len(own) + 1) * (kept.shape[1] * kept.itemsize))
    units = pa.nulls(len(own), pa.int64()) if unit is None else pa.array(np.full(len(own), unit, np.int64))
    return emit({"slice": own, "unit": units, "gram": np.full(len(own), gram), "low": cells(low, ends * low.itemsize), "high": high, "seen": flag_cells(counts > 0, n), "again": flag_cells(again, n), "counts": cells(more, more_ends * more.itemsize)}, COUNTS)


def uncounted(rows: pa.Table, slices: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of rows of ``count_batch`` of one slice and order, and how many each row has."""
    low, size = uncelled(rows.column("low"))
    if gram == 1:
        n, hashes = size // 8, low.view(np.uint64)
    else:
        n, hashes = size // 4, low.view(np.uint32).astype(np.uint64)
        per, many = (1 << 16) // slices, uncelled(rows.column("high"))
        if len(n):
            first = int(rows.column("slice")[0].as_py()) * per
            upper = np.tile(np.arange(first, first + per, dtype=np.uint64), len(n))
            hashes |= np.repeat(upper, widened(*many, np.full(len(n), per))) << np.uint64(32)
    counts, again = unflagged(rows.column("seen"), n).astype(np.int64), unflagged(rows.column("again"), n)
    ends = np.cumsum(n)
    upto = np.concatenate(([0], np.cumsum(again)))
    counts[again] = widened(*uncelled(rows.column("counts")), upto[ends] - upto[ends - n])
    return hashes, counts, n


def count_rows(docs: DataFrame, slices: int) -> DataFrame:
    """Per task, slice and order: hashes and counts of the n-grams of the training texts."""

    def run(batches):
        held, size = {g: [] for g in (1, 2, 3)}, dict.fromkeys((1, 2, 3), 0)
        for table in blocks(batches, "text"):
            train = ~held_out(table.column("doc_id").to_pylist())
            own = Tokens.of(strings(table.filter(pa.array(train)), "text"))
            pair, triple, inner = own.grams()
            for g, found in ((1, tally(own.known, np.bincount(own.place, minlength=len(own.known)))), (2, tally(pair)), (3, tally(triple[inner]))):
                if g == 1:
                    found = tuple(x[found[1] > 0] for x in found)
                held[g].append(found)
                size[g] += len(found[0])
                if size[g] > HELD:
                    yield count_batch(*tally(*map(np.concatenate, zip(*held[g]))), slices, g)
                    held[g], size[g] = [], 0
        for g in held:
            if size[g]:
                yield count_batch(*tally(*map(np.concatenate, zip(*held[g]))), slices, g)

    bound_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, COUNTS_DDL)


def quantise(counts: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1


def count_bounds(levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest count that a level stands for. The filter holds nothing below the level of ``LEAST``: a lower answer is a false one and means absent."""
    every = np.arange(int(levels.max(initial=0)) + 1)
    held = every >= quantise(np.array([LEAST]))[0]
    return np.where(held, np.exp2(every - 1.0), 0.0)[levels], np.where(held, np.exp2(every) - 1, 0.0)[levels]


def level_hash(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes + mix(np.array([level], np.uint64)))


def build_bits(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Filter bits holding each hash at levels 1..its level; BITS_PER_ENTRY bits for each entry."""
    size = max(64, int(levels.sum()) * BITS_PER_ENTRY)
    flags = np.zeros(size, np.uint8)
    for level in range(1, int(levels.max(initial=0)) + 1):
        h = level_hash(hashes[levels >= level], level)
        for m in MULTIPLIERS:
            flags[((h * m) >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)] = 1
    return np.packbits(flags)


class Slice:
    """A slice of all n-grams: per order the distinct hashes with their counts, the place of each sent hash among them, and how many each row sent."""

    def __init__(self, table: pa.Table, slices: int):
        self.slices, self.own = slices, int(table.column("slice")[0].as_py())
        self.rows, self.hashes, self.counts, self.place, self.n = {}, {}, {}, {}, {}
        grams = table.column("gram").to_numpy()
        for g in (1, 2, 3):
            self.rows[g] = table.filter(pa.array(grams == g))
            hashes, counts, self.n[g] = uncounted(self.rows[g], slices, g)
            hashes, order = self.sorted(hashes, g)
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            first = np.flatnonzero(new)
            self.hashes[g], self.counts[g] = hashes[first], np.add.reduceat(counts[order], first) if len(first) else counts
            self.place[g] = np.empty(len(hashes), np.int64)
            self.place[g][order] = np.cumsum(new) - 1

    def sorted(self, hashes: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes in order, and their places before. The places go into the bits that all hashes of the slice share, where these suffice: to sort values is faster than to sort places."""
        bits, shared = np.uint64(max(1, len(hashes) - 1).bit_length()), self.slices.bit_length() - 1
        if gram == 1 or bits > 16 + shared:
            order = np.argsort(hashes)
            return hashes[order], order
        upper = np.uint64(self.own << (48 - shared))
        keys = np.sort((hashes - upper) << bits | np.arange(len(hashes), dtype=np.uint64))
        return (keys >> bits) + upper, (keys & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)

    def totals(self) -> dict[str, list[int]]:
        """What the slice adds to the totals: distinct tokens, all tokens, texts, occurrences of repeated bigrams and trigrams."""
        one = self.counts[1]
        ends = one[self.hashes[1] == END].sum()
        return {"n": [int((one > 0).sum())], "total": [int(one.sum())], "ends": [int(ends)]} | {f"mass{g}": [int(self.counts[g][self.counts[g] >= LEAST].sum())] for g in (2, 3)}

    def bits(self) -> tuple[int, np.ndarray]:
        """Size and bits of the filter."""
        hashes, counts = (np.concatenate([x[g][self.counts[g] >= LEAST] for g in (2, 3)]) for x in (self.hashes, self.counts))
        levels = quantise(counts)
        return max(64, int(levels.sum()) * BITS_PER_ENTRY), build_bits(hashes, levels)


def merge(slices: int):
    """Merge the counts of a slice: unigrams with their counts, and filter bits."""

    def run(table: pa.Table) -> pa.Table:
        own = Slice(table, slices)
        size, bits = own.bits()
        seen = own.counts[1] > 0
        found = {"slice": [own.own], "once": [int((own.counts[1] == 1).sum())], "size": [size], "bits": [bits.tobytes()], "hashes": [own.hashes[1][seen].tobytes()], "counts": [own.counts[1][seen].tobytes()]}
        return pa.Table.from_batches([emit(found | own.totals(), MERGED)])

    return run


def answer(slices: int):
    """Merge a slice and answer every unit: counts of its tokens and levels of its longer n-grams, in the order in which it sent them. A row without unit has the totals."""

    def run(table: pa.Table) -> pa.Table:
        own = Slice(table, slices)
        size, bits = own.bits()
        held = Filter(1, [(0, size, bits)], len(bits))
        none = {x: [None] for x in ("unit", "gram", "values")} | {"slice": [own.own]}
        out = [emit(none | own.totals(), ANSWERS)]
        for g, rows in own.rows.items():
            if len(rows):
                known = np.where(own.counts[g] >= LEAST, quantise(own.counts[g]), 0)
                got = narrow((own.counts[g] if g == 1 else held.levels(own.hashes[g], known))[own.place[g]])
                empty = {x: pa.nulls(len(rows), pa.int64()) for x in ("total", "ends", "mass2", "mass3")} | {"n": own.n[g]}
                out.append(emit({"unit": rows.column("unit"), "gram": rows.column("gram"), "slice": rows.column("slice"), "values": cells(got, np.cumsum(own.n[g]) * got.itemsize)} | empty, ANSWERS))
        return pa.Table.from_batches(out)

    return run


class Filter:
    """Slices of filter bits side by side; ``parts`` gives (slice, size in bits, bytes), ``total`` their bytes in all."""

    def __init__(self, slices: int, parts, total: int):
        self.slices = slices
        self.size, self.start = np.zeros(slices, np.uint64), np.zeros(slices, np.uint64)
        self.bits, at = np.zeros(total, np.uint8), 0
        for s, size, raw in parts:
            self.size[s], self.start[s] = size, at * 8
            self.bits[at : at + len(raw)] = np.frombuffer(raw, np.uint8)
            at += len(raw)

    def levels(self, hashes: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
        """Level of each hash by repeated probes, 0 if absent. Levels up to which hashes are known to be held need no probe."""
        out = np.zeros(len(hashes), np.int64) if known is None else known.astype(np.int64)
        own = slice_of(hashes, self.slices, 2)
        there = self.size[own] > 0
        if known is None:
            waits = {0: np.flatnonzero(there)}
        else:
            waits = {int(k): np.flatnonzero(there & (out == k)) for k in np.flatnonzero(np.bincount(out))}
        live, level = np.empty(0, np.int64), 0
        while len(live) or waits:
            live = np.concatenate((live, waits.pop(level, live[:0])))
            level += 1
            h = level_hash(hashes[live], level)
            for m in MULTIPLIERS:
                s = own[live] if self.slices > 1 else 0
                at = self.start[s] + ((((h * m) >> np.uint64(32)) * self.size[s]) >> np.uint64(32))
                there = (self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1
                live, h = live[there], h[there]
            out[live] = level
        return out


class Lookup:
    """Sorted hashes with a value each; 0 for others."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray):
        self.hashes, self.values = hashes, values

    def get(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.values[at], 0).astype(np.int64)


class Answers:
    """What the slices answered to a unit: a value for each of its distinct hashes, in order. ``bits`` is the width of the hashes."""

    def __init__(self, values: np.ndarray, bits: int):
        self.values, self.bits = values, bits

    def get(self, hashes: np.ndarray) -> np.ndarray:
        distinct = np.sort(hashes)
        distinct = distinct[np.concatenate(([True], distinct[1:] != distinct[:-1]))] if len(distinct) else distinct
        if len(distinct) != len(self.values):
            raise ValueError(f"{len(self.values)} answers to {len(distinct)} n-grams of a unit")
        # hashes are spread evenly: the first place by their upper bits is right or a few short
        width = len(distinct).bit_length()
        upper = np.uint64(self.bits - width)
        at = np.concatenate(([0], np.cumsum(np.bincount((distinct >> upper).astype(np.int64), minlength=1 << width))))[hashes >> upper]
        live = np.flatnonzero(distinct[at] != hashes)
        while len(live):
            at[live] += 1
            live = live[distinct[at[live]] != hashes[live]]
        return self.values[at]

    levels = get  # asked like a filter


class Counts:
    """Exact counts by hash. Words seen once, most of a vocabulary, need no count beside them."""

    def __init__(self, once: np.ndarray, more: Lookup):
        self.once, self.more = once, more

    def get(self, hashes: np.ndarray) -> np.ndarray:
        out = self.more.get(hashes)
        if len(self.once):
            at = np.minimum(np.searchsorted(self.once, hashes), len(self.once) - 1)
            out[self.once[at] == hashes] = 1
        return out


class Totals(NamedTuple):
    """Tokens, distinct tokens and texts of the training, and the weights of bigrams and trigrams."""

    n: int
    v: int
    n_texts: int
    weight2: float
    weight3: float


class Model:
    """Unigram counts, levels of longer n-grams, totals, and the weights of bigrams and trigrams."""

    def __init__(self, unigrams, pairs, triples, totals: "Totals"):
        self.unigrams, self.pairs, self.triples = unigrams, pairs, triples
        self.n, self.v, self.n_texts, self.weight2, self.weight3 = totals

    def probabilities(self, own: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count, base probability and model probability of each token."""
        count = self.unigrams.get(own.known)[own.place]
        pair_hash, triple_hash, inner = own.grams()
        history = own.earlier(count, self.n_texts)
        p1 = (count + 1) / (self.n + self.v + 1)
        # no n-gram is more frequent than what it is made of; the smallest count above and the largest below keep the sum over all words within 1
        pair, pair_most = (np.minimum(c, np.minimum(count, history)) for c in count_bounds(self.pairs.levels(pair_hash)))
        p = (1 - self.weight2) * p1 + self.weight2 * pair / np.maximum(history, 1)
        at = np.flatnonzero(inner)
        before = own.earlier(pair_most, 0.0)[at]
        triple = np.minimum(count_bounds(self.triples.levels(triple_hash[at]))[0], np.minimum(pair_most[at], before))
        weight = np.where(before > 0, self.weight3, 0.0)
        p[at] = (1 - weight) * p[at] + weight * triple / np.maximum(before, 1)
        return count, p1, p

    def score(self, ids: list[int | None], own: Tokens) -> pa.RecordBatch:
        count, p1, p = self.probabilities(own)
        sums = lambda x: np.add.reduceat(x, own.first) if len(own.first) else np.empty(0)
        return emit({"doc_id": ids, "held_out": held_out(ids), "n_tokens": own.counts, "n_known": sums((count > 0).astype(np.int64)), "base_score": sums(np.log10(p1)), "score": sums(np.log10(p))}, SCORES)


def score_texts(docs: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "lm")
    bound_batches(spark)
    source = alias_free(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    size = source.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    slices = slices_of(size)
    if size > TEXT_PER_MODEL * broadcast_bytes:
        return score_by_units(source, slices, tasks_of(spark, size), scratch)
    merged = scratch.keep(count_rows(source, slices).groupBy("slice").applyInArrow(merge(slices), MERGED_DDL), "counts")
    zero = F.lit(0).cast("long")
    room = merged.agg(F.coalesce(F.sum(F.col("n") * 12 - F.col("once") * 4), zero).alias("unigrams"), F.coalesce(F.sum(F.length("bits").cast("long")), zero).alias("bits")).first()
    if room["unigrams"] + room["bits"] > broadcast_bytes:
        scratch.drop(merged)
        return score_by_units(source, slices, tasks_of(spark, size), scratch)
    totals, bits = totals_of(merged), int(room["bits"])
    n = totals.n
    # slices are ranges of the hash, so in their order the hashes are sorted
    sizes = sorted((r["slice"], r["once"], r["n"] - r["once"]) for r in merged.select("slice", "n", "once").collect())
    places, once_at, more_at = {}, 0, 0
    for own, once, more in sizes:
        places[own] = slice(once_at, once_at + once), slice(more_at, more_at + more)
        once_at, more_at = once_at + once, more_at + more
    once, more, counts = np.empty(once_at, np.uint64), np.empty(more_at, np.uint64), np.empty(more_at, np.uint32 if n < 1 << 32 else np.int64)
    for r in merged.select("slice", "hashes", "counts").toLocalIterator():
        h, c = np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)
        first, second = places[r["slice"]]
        once[first], more[second], counts[second] = h[c == 1], h[c > 1], c[c > 1]
    held = Filter(slices, ((r["slice"], r["size"], r["bits"]) for r in merged.select("slice", "size", "bits").toLocalIterator()), bits)
    shared = spark.sparkContext.broadcast(Model(Counts(once, Lookup(more, counts)), held, held, totals))

    def run(batches):
        for table in blocks(batches, "text", SCORE_BYTES):
            yield shared.value.score(table.column("doc_id").to_pylist(), Tokens.of(strings(table, "text")))

    return with_total(source.mapInArrow(run, SCORES_DDL), n)


def with_total(scores: DataFrame, n: int) -> DataFrame:
    return scores.withColumn("train_tokens", F.lit(n).cast("long"))


def totals_of(merged: DataFrame) -> Totals:
    got = merged.agg(*[F.coalesce(F.sum(c), F.lit(0).cast("long")).alias(c) for c in ("total", "n", "ends", "mass2", "mass3")]).first()
    weights = (min(MOST_WEIGHT, part / max(whole, 1)) for part, whole in ((got["mass2"], got["total"]), (got["mass3"], got["mass2"])))
    return Totals(got["total"], got["n"], got["ends"], *weights)


def tasks_of(spark: SparkSession, size: int) -> int:
    """Tasks that units and slices are dealt over."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))


def frozen(ids: pa.ChunkedArray, own: Tokens) -> bytes:
    """The tokens of a unit and the doc_id of its texts."""
    one = lambda values, kind: pa.array([values], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays([one(ids.to_pylist(), pa.int64()), one(own.known, pa.uint64()), one(own.place.astype(np.uint32), pa.uint32()), one(own.counts, pa.int64())], names=["ids", "known", "place", "counts"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thawed(tokens: pa.Scalar) -> tuple[list[int | None], Tokens]:
    batch = pa.ipc.open_stream(tokens.as_buffer()).read_next_batch()
    known, place, counts = (batch.column(x).flatten().to_numpy() for x in ("known", "place", "counts"))
    return batch.column("ids").flatten().to_pylist(), Tokens(known, place, counts)


def tally_of(hashes: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit hashes in order and how many of each are of training texts."""
    marked = np.sort(hashes << np.uint64(1) | train)
    hashes = marked >> np.uint64(1)
    new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))) if len(hashes) else np.empty(0, np.int64)
    return hashes[new], np.add.reduceat(marked & np.uint64(1), new) if len(new) else marked


def unit_counts(unit: int, ids: list[int | None], own: Tokens, slices: int) -> Iterator[pa.RecordBatch]:
    """All n-grams of a unit, with their counts in its training texts: a batch for each order."""
    train = np.repeat(~held_out(ids), own.counts)
    pair, triple, inner = own.grams()
    yield count_batch(*tally(own.known, np.bincount(own.place[train], minlength=len(own.known))), slices, 1, unit)
    yield count_batch(*tally_of(pair, train), slices, 2, unit)
    if inner.any():
        yield count_batch(*tally_of(triple[inner], train[inner]), slices, 3, unit)


def score_by_units(source: DataFrame, slices: int, tasks: int, scratch: Scratch) -> DataFrame:
    """The same scores where the model is too large to broadcast.

    Units are cut where the rows are read, so equal rows never gather, and a unit is one row of hashed tokens, which no reader divides. The filter's slices are those of the
    broadcast way, so the scores are equal.
    """

    def cut(batches):
        base = TaskContext.get().partitionId() << 32
        for i, table in enumerate(blocks(batches, "text", UNIT_BYTES)):
            yield pa.RecordBatch.from_arrays([pa.array([base + i], pa.int64()), pa.array([frozen(table.column("doc_id"), Tokens.of(strings(table, "text")))], pa.binary())], names=["unit", "tokens"])

    units = scratch.keep(source.mapInArrow(cut, "unit long, tokens binary"), "units", **LARGE_ROWS)

    def ask(batches):
        for batch in batches:
            for unit, tokens in zip(batch.column("unit"), batch.column("tokens")):
                yield from unit_counts(unit.as_py(), *thawed(tokens), slices)

    answers = scratch.keep(units.mapInArrow(ask, COUNTS_DDL).repartition(tasks, "slice").groupBy("slice").applyInArrow(answer(slices), ANSWERS_DDL), "answers")
    totals = totals_of(answers.where("unit is null"))
    scratch.release()  # behind another query, as Spark holds on to the last one: the units' counts are the largest shuffle by far

    def score(own: pa.Table, got: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_batches([], SCORES)
        got, sides = got.sort_by([("gram", "ascending"), ("slice", "ascending")]), []
        grams = got.column("gram").to_numpy()
        for g in (1, 2, 3):
            rows = got.filter(pa.array(grams == g))
            sides.append(Answers(widened(*uncelled(rows.column("values")), rows.column("n").to_numpy()), 64 if g == 1 else 48))
        return pa.Table.from_batches([Model(*sides, totals).score(*thawed(own.column("tokens")[0]))])

    asked = units.repartition(tasks, "unit").groupBy("unit")
    told = answers.where("unit is not null").select("unit", "gram", "slice", "values", "n").repartition(tasks, "unit").groupBy("unit")
    return with_total(asked.cogroup(told).applyInArrow(score, SCORES_DDL), totals.n)
