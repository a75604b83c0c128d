"""Near-duplicate documents by a multi-index Hamming join over b-bit MinHash signatures.

A signature has ``SYMBOLS`` symbols of 16 bits; their Hamming distance is the number of differing symbols. It is cut
into chunks. If two signatures differ in at most ``distance`` symbols, by pigeonhole some chunk pair differs in
at most floor(distance / chunks) = 1 symbol, so indexing every chunk with each one of its symbols left out in turn
makes all such pairs meet. At similarity 0.85 the distance is binomial with mean 9.6; it exceeds 21 once in 10,000 pairs, and
a document is lost only if that holds for all its links. A lower threshold comes with a larger distance and more chunks (``Limit``):
at similarity 0.8 the mean is 12.8 and the distance 25 is exceeded once in 7,900 pairs.

Documents with equal shingle sets form one class first, so copies are never compared. Candidate pairs of classes are
tested on full shingle sets: first one partner per class, then, between components only, the remaining candidates
whose signatures are within the distance. In a bucket of at most ``SMALL`` classes all pairs are candidates. In a larger one
the smallest class is paired with the others; where such a bucket still joins several components afterwards, its classes are
compared by a prefix filter over their full sets, which lists every pair that can be linked, so no link is lost to a cap.

Hot keys: an index key, and a shingle, with more than a thousandth of its table's rows is found by counting (of such keys there are a thousand at most, so their list may
be broadcast) and never gathers its rows: an index key's classes meet its smallest class where they are, a shingle's rows are dealt over as many salts as it needs.

Defined results: a null or empty text has no shingles, is linked with nothing and is kept; fewer than five words make one
shingle; repeated rows are copies with one doc_id and get the same row; a row without doc_id is a copy like others, but never
names a component. Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditgrove.llm.components import connected_components
from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, hash_strings, mix, rolling, split_words, strings

WIDTH = 5
SYMBOLS, SMALL, SALTS = 64, 16, 32
#: A key is hot with more than one row in HOT_SHARE; keys are counted on one class in KEY_SAMPLE, which decides how rows are dealt and nothing else.
HOT_SHARE, KEY_SAMPLE = 1000, 16
#: Rows of a shingle that meet in one group.
SPLIT = 256
MARK_BITS = 1 << 25


class Limit(NamedTuple):
    """Sets are linked at a similarity of ``percent`` or more; ``distance`` must be less than twice ``chunks``."""

    percent: int
    chunks: int
    distance: int

    @property
    def borders(self) -> list[int]:
        return [SYMBOLS * i // self.chunks for i in range(self.chunks + 1)]


#: Of op4_near_duplicates, and of the pipeline's stage, which takes all pairs of similarity 0.8 or more.
CONTRACT, STAGE = Limit(85, 11, 21), Limit(80, 13, 25)
SEEDS = mix(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64()), ("signature", pa.binary())])
KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
PAIRS = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    counts, codes, words = split_words(texts, lower=True)
    hashes = hash_strings(words)[codes] if len(codes) else np.empty(0, np.uint64)
    runs = rolling(hashes, WIDTH)
    ends = np.cumsum(counts)
    out = []
    for start, end in zip(ends - counts, ends):
        if end - start >= WIDTH:
            own = np.sort(runs[start : end - WIDTH + 1])
            out.append(own[np.concatenate(([True], own[1:] != own[:-1]))])
        else:
            out.append(rolling(np.append(hashes[start:end], np.uint64(end - start)), int(end - start) + 1) if end > start else np.empty(0, np.uint64))
    return out


def node_of(own: np.ndarray) -> int:
    """Class id: 64-bit hash of a whole shingle set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(own.tobytes())).view(np.int64))


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of SYMBOLS 16-bit MinHash symbols for each non-empty set."""
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    values = np.concatenate(sets)
    out = np.empty((len(sets), SYMBOLS), dtype=np.uint16)
    for k in range(SYMBOLS):
        least = np.minimum.reduceat((values ^ SEEDS[2 * k]) * (SEEDS[2 * k + 1] | np.uint64(1)), starts)
        out[:, k] = mix(least).astype(np.uint16)
    return out


def document_sets(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Set size, class id and signature of every row (named by its ``key``); the last two are null for an empty set."""
    bound_batches(docs.sparkSession)

    def run(batches):
        for table in blocks(batches, "text"):
            sets = shingle_sets(strings(table, "text"))
            full = [i for i, s in enumerate(sets) if len(s)]
            signed = signatures([sets[i] for i in full]) if full else []
            node, signature = [None] * len(sets), [None] * len(sets)
            for row, i in enumerate(full):
                node[i], signature[i] = node_of(sets[i]), signed[row].tobytes()
            yield emit({"doc_id": table.column("doc_id"), "n_shingles": [len(s) for s in sets], "node": node, "signature": signature}, SETS)

    source = alias_free(docs, key, "text").select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string"))
    return source.mapInArrow(run, "doc_id long, n_shingles long, node long, signature binary")


def index_keys(classes: DataFrame, limit: Limit) -> DataFrame:
    """Per class one key for each symbol left out of its chunk."""
    borders = limit.borders

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, SYMBOLS).astype(np.uint64)
            keys = []
            for first, last in zip(borders, borders[1:]):
                for out in range(first, last):
                    h = np.full(len(signed), out + 1, dtype=np.uint64)
                    for j in range(first, last):
                        if j != out:
                            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + signed[:, j])
                    keys.append(h.view(np.int64))
            yield emit({"key": np.concatenate(keys), "node": np.tile(batch.column("node").to_numpy(), len(keys))}, KEYS)

    return classes.select("node", "signature").mapInArrow(run, "key long, node long")


def bucket_pairs(keys: DataFrame) -> DataFrame:
    """Candidates of each bucket; ``key`` is set on the rows of large buckets, whose pairs are only those with the centre."""

    def pairs_of(key: np.ndarray, node: np.ndarray, centre: int, large: bool):
        """Of whole runs of equal keys; with ``large``, of a part of one large bucket."""
        if large:
            n = node != centre
            return [(key[n], np.full(n.sum(), centre), node[n])]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        size = np.repeat(sizes, sizes)
        centres = np.repeat(node[starts], sizes)
        big = (size > SMALL) & (node != centres)
        found = [(key[big], centres[big], node[big])]
        for d in range(1, SMALL):
            at = np.flatnonzero((key[d:] == key[:-d]) & (size[d:] <= SMALL) & (node[d:] != node[:-d]))
            if not len(at):
                break
            found.append((None, node[at], node[at + d]))
        return found

    def rows(found):
        for key, a, b in found:
            if len(a):
                yield emit({"key": pa.nulls(len(a), pa.int64()) if key is None else key, "a": a, "b": b}, PAIRS)

    def run(batches):
        held_key, held_node = np.empty(0, np.int64), np.empty(0, np.int64)
        open_key = open_centre = None  # of a large bucket whose first rows are out already
        for batch in batches:
            key = np.concatenate((held_key, batch.column("key").to_numpy()))
            node = np.concatenate((held_node, batch.column("node").to_numpy()))
            if open_key is not None and len(key):
                upto = int(np.searchsorted(key != open_key, True)) if (key != open_key).any() else len(key)
                yield from rows(pairs_of(key[:upto], node[:upto], open_centre, True))
                key, node = key[upto:], node[upto:]
                if len(key):
                    open_key = None
            if not len(key):
                held_key, held_node = key, node
                continue
            last = int(np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))[-1])
            yield from rows(pairs_of(key[:last], node[:last], 0, False) if last else [])
            held_key, held_node = key[last:], node[last:]
            if len(held_key) > 4096:  # one large bucket: send on what is here and keep only its centre
                open_key, open_centre = held_key[0], held_node[0]
                yield from rows(pairs_of(held_key, held_node, open_centre, True))
                held_key, held_node = held_key[:0], held_node[:0]
        if len(held_key):
            yield from rows(pairs_of(held_key, held_node, 0, False))

    dealt = keys.repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(run, "key long, a long, b long")


def hot_keys(keys: DataFrame, column: str, scratch: Scratch) -> DataFrame:
    """The values of a column with more than one row in HOT_SHARE of the table: at most HOT_SHARE rows, whatever the table."""
    counted = keys.groupBy(column).agg(F.count("*").alias("n"))
    total = F.broadcast(keys.agg(F.count("*").alias("total")))  # one row
    return scratch.keep(counted.where("n > 16").crossJoin(total).where(F.col("n") * HOT_SHARE > F.col("total")).select(column, "n"), "hot")


def centre_pairs(keys: DataFrame) -> DataFrame:
    """Of hot keys: every class with the smallest class of its key. Minima are taken before the shuffle; no row is dealt by its key."""
    centres = keys.groupBy("key").agg(F.min("node").alias("a"))  # a row per hot key
    return keys.join(F.broadcast(centres), "key").where("node <> a").select("key", "a", F.col("node").alias("b"))


def met_in_buckets(classes: DataFrame, limit: Limit, scratch: Scratch) -> DataFrame:
    keys = index_keys(classes, limit)
    sample = index_keys(classes.where(F.pmod(F.xxhash64("node"), F.lit(KEY_SAMPLE)) == 0), limit)
    hot = F.broadcast(hot_keys(sample, "key", scratch).select("key"))
    return bucket_pairs(keys.join(hot, "key", "left_anti")).unionByName(centre_pairs(keys.join(hot, "key", "left_semi")))


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct hashes."""
    few, many = (x, y) if len(x) < len(y) else (y, x)
    if not len(few) or 100 * len(few) < percent * len(many):
        return False
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return 100 * both >= percent * (len(few) + len(many) - both)


def verified(pairs: DataFrame, texts: DataFrame, limit: Limit) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough.

    The members of a centre are dealt over SALTS groups, each of which reads the centre's text first and then its
    members one after the other, so a centre with very many members is no bottleneck and nothing is collected.
    """
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("b"), F.lit(SALTS)).alias("salt"))
    members = salted.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", F.lit(1).alias("kind"), "b", "text")
    centres = salted.select("a", "salt").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("b"), "text")
    percent = limit.percent
    dealt = members.unionByName(centres).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "b")

    def run(batches):
        centre, centre_of = np.empty(0, np.uint64), None
        for table in blocks(batches, "text"):
            found = []
            for a, b, kind, own in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("kind").to_pylist(), shingle_sets(strings(table, "text"))):
                if node_of(own) != b:  # another row's text under the same doc_id
                    continue
                if kind == 0:
                    centre, centre_of = own, a
                    continue
                if centre_of == a and similar(own, centre, percent):
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def within_distance(pairs: DataFrame, classes: DataFrame, limit: Limit) -> DataFrame:
    """The pairs whose signatures differ in at most ``limit.distance`` symbols."""
    distance = limit.distance
    signed = classes.select("node", "signature")
    both = pairs.join(signed.toDF("a", "sa"), "a").join(signed.toDF("b", "sb"), "b")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
                yield batch.select(["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= distance))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def across(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components so far."""
    own = comps.select("node", "component")
    joined = pairs.join(own.toDF("a", "ca"), "a", "left").join(own.toDF("b", "cb"), "b", "left")
    return joined.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select(*pairs.columns)


def component_table(docs: DataFrame, limit: Limit = CONTRACT, key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs`` (columns doc_id and text).

    With another ``key`` column, long and different in every row, the rows are named by it, in the columns called doc_id and component_id.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "near-dup")
    sets = scratch.keep(document_sets(docs, key), "sets")
    named = sets.where("node is not null")
    classes = scratch.keep(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("signature").alias("signature")), "classes")
    bound_batches(spark)
    met = scratch.keep(met_in_buckets(classes.where("doc_id is not null" if key == "doc_id" else "true"), limit, scratch), "met")
    candidates = scratch.keep(met.groupBy("a", "b").agg(F.count("*").alias("hits")), "candidates")
    needed = candidates.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(classes.select("node", "doc_id"), "node")
    needed = scratch.keep(needed, "needed")
    source = alias_free(docs, key, "text").select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string"))
    texts = scratch.keep(only_marked(source, needed).join(needed, "doc_id").select("node", "text"), "texts")

    first = candidates.groupBy("b").agg(F.max_by("a", F.struct("hits", -F.col("a"))).alias("a"))
    tested = scratch.keep(first.select("a", "b"), "tested")
    links = scratch.keep(verified(tested, texts, limit), "links")
    comps = scratch.keep(connected_components(links, scratch), "components")
    rest = across(candidates.select("a", "b").join(tested, ["a", "b"], "left_anti"), comps)
    rest = scratch.keep(within_distance(rest, classes, limit), "rest")
    if rest.limit(1).count():
        links = scratch.keep(links.unionByName(verified(rest, texts, limit)), "links")
        comps = scratch.keep(connected_components(links, scratch), "components")
    large = met.where("key is not null")
    if large.limit(1).count():
        links, comps = settle_large(large, candidates.select("a", "b"), classes, texts, links, comps, scratch, limit)

    # classes alone in their component name it themselves; the others fetch the name, over salts, as one component may hold a large share of them
    named_class = classes.select("node", "doc_id")
    linked = scratch.keep(named_class.join(comps, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")), "linked")
    names = linked.groupBy("component").agg(F.min("doc_id").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    alone = named_class.join(comps.select("node"), "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    of_class = alone.unionByName(linked.join(names, ["component", "salt"]).select("node", "component_id"))
    out = sets.select("doc_id", "n_shingles", "node").join(of_class, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def only_marked(source: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows whose doc_id may be needed, so that other texts are not shuffled.

    The needed ids are marked in a bitmap of MARK_BITS bits (4 MB, whatever the corpus) that goes to all tasks; when it fills
    up at very large inputs it lets more rows through and stays right.
    """
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(MARK_BITS))
    flags = np.zeros(MARK_BITS // 8 + 8192, np.uint8)
    for r in marks_of(needed, spot).collect():
        at = (r["bucket"] - 1) * 4096 if r["bucket"] > 0 else len(flags) - 4096
        flags[at : at + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    shared = source.sparkSession.sparkContext.broadcast(flags)

    def run(batches):
        for batch in batches:
            at = batch.column("spot").to_numpy()
            bucket, bit = np.where(at > 0, 1 + (at - 1) // 32768, 0), np.where(at > 0, (at - 1) % 32768, 0)
            start = np.where(bucket > 0, (bucket - 1) * 4096, len(shared.value) - 4096)
            keep = (shared.value[start + bit // 8] >> (bit % 8).astype(np.uint8)) & 1 == 1
            yield batch.select(["doc_id", "text"]).filter(pa.array(keep))

    return source.where("doc_id is not null").withColumn("spot", spot).mapInArrow(run, "doc_id long, text string")


def settle_large(large, candidates, classes, texts, links, comps, scratch, limit):
    """Compare what is left in large buckets that still join several components, by an exact prefix filter.

    Two sets of similarity ``percent`` or more share one of their first n - ceil(n * percent / 100) + 1 shingles in any common
    order. In the order of frequency the passages that make unlike documents meet in a bucket come last, so
    hardly any pair of those is listed. At its first common shingle a linked pair still has enough shingles ahead on both
    sides for the overlap it needs, so pairs that fall short there are left out as well, and no linked pair is missed.
    """
    members = large.select("key", F.col("b").alias("node")).unionByName(large.select("key", F.col("a").alias("node")).distinct())
    own = members.join(comps, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    mixed = own.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    salted = own.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))  # a large bucket is dealt over SALTS tasks
    mixed = mixed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = scratch.keep(salted.join(mixed, ["key", "salt"], "left_semi").select("node", "component").distinct(), "open-nodes")
    if not nodes.limit(1).count():
        return links, comps

    def explode_sets(batches):
        for table in blocks(batches, "text"):
            sets = shingle_sets(strings(table, "text"))
            keep = [i for i, n in enumerate(table.column("node").to_pylist()) if len(sets[i]) and node_of(sets[i]) == n]
            sizes = [len(sets[i]) for i in keep]
            node = table.column("node").to_numpy()[keep] if keep else np.empty(0, np.int64)
            flat = np.concatenate([sets[i] for i in keep]).view(np.int64) if keep else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, sizes)), pa.array(flat)], names=["node", "shingle"])

    rows = scratch.keep(texts.join(nodes.select("node"), "node", "left_semi").mapInArrow(explode_sets, "node long, shingle long").distinct(), "open-shingles")
    hot = F.broadcast(hot_keys(rows, "shingle", scratch))
    cold = rows.join(hot.select("shingle"), "shingle", "left_anti")
    counted = cold.join(cold.groupBy("shingle").agg(F.count("*").alias("seen")), "shingle").unionByName(rows.join(hot.withColumnRenamed("n", "seen"), "shingle"))
    ranked = counted.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("seen", "shingle"))).alias("s"))  # a document's set
    n = F.size("s")
    prefix = ranked.select("node", n.alias("n"), F.posexplode(F.slice("s", F.lit(1), n - F.ceil(n * limit.percent / 100).cast("int") + 1)).alias("at", "s")).where("s.seen > 1")
    prefix = scratch.keep(prefix.select(F.col("s.shingle").alias("shingle"), "node", (F.col("n") - F.col("at")).alias("ahead"), "n"), "prefixes")
    known = candidates
    for step in range(3):
        placed = prefix.join(comps, "node", "left").select("shingle", "node", "ahead", "n", F.coalesce("component", "node").alias("component"))
        several = placed.groupBy("shingle").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
        # a shingle with many rows is dealt over salts, by the class: one side's rows go to their salt, the other side's to all of them
        parts = several.select("shingle", F.ceil(F.col("rows") / SPLIT).cast("int").alias("salts"))
        spread = F.pmod(F.xxhash64("node"), F.col("salts").cast("long")).cast("int")
        own = placed.withColumn("at", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(parts.withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["shingle", "at"]).drop("at")
        some = scratch.keep(own.withColumn("salt", spread), "mixed")
        y = some.select("shingle", "salt", F.col("node").alias("b"), F.col("ahead").alias("ahead_b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
        x = some.select("shingle", "salts", F.col("node").alias("a"), F.col("ahead").alias("ahead_a"), F.col("n").alias("na"), F.col("component").alias("ca"))
        if step < 2:  # first only against the class with the fewest rare shingles, which joins most of a family
            centre = x.groupBy("shingle").agg(F.max_by(F.struct("salts", "a", "ahead_a", "na", "ca"), F.struct(F.col("ahead_a") / F.col("na"), "na", "a")).alias("c"))
            x = centre.select("shingle", "c.*")
        x = x.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        enough = F.least("ahead_a", "ahead_b") * (100 + limit.percent) >= (F.col("na") + F.col("nb")) * limit.percent
        alike = (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * limit.percent) & enough
        near = alike & ((F.col("a") != F.col("b")) if step < 2 else (F.col("a") < F.col("b"))) & (F.col("ca") != F.col("cb"))
        met = x.join(y, ["shingle", "salt"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = scratch.keep(met.join(known, ["a", "b"], "left_anti"), "fresh")
        known = known.unionByName(fresh)
        close = scratch.keep(within_distance(fresh, classes, limit), "close")
        if close.limit(1).count():
            links = scratch.keep(links.unionByName(verified(close, texts, limit)), "links")
            comps = scratch.keep(connected_components(links, scratch), "components")
    return links, comps


def marks_of(ids: DataFrame, spot) -> DataFrame:
    """Bitmap (bucket, bits) of the spots in 0 .. MARK_BITS - 1: at most MARK_BITS / 32768 + 1 rows of 4 KB, whatever the corpus."""
    spots = ids.select(F.bitmap_bucket_number(spot).alias("bucket"), F.bitmap_bit_position(spot).alias("bit"))
    return spots.groupBy("bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def keep_one_of_each(docs: DataFrame, limit: Limit = CONTRACT) -> DataFrame:
    """One row of each component, all columns unchanged: that with the smallest doc_id, rows without one last, and of equal ones the first row.

    The rows are written once with a key of their own, by which they are judged, so rows that share a doc_id or have none are told apart.
    Only rows whose key may be a dropped one, by a bitmap of fixed size, are joined with the dropped keys; the texts of the others are
    not shuffled. When the bitmap fills up at very large inputs, more rows take the join and the result is the same.
    """
    scratch = Scratch(docs.sparkSession, "near-dup-verdicts")
    free = "_" * (1 + max(len(c) for c in docs.columns))  # no column of the rows has these names
    key = f"key{free}"
    keyed = scratch.keep(docs.withColumn(key, F.monotonically_increasing_id()), "rows")
    table = scratch.keep(component_table(keyed, limit, key).select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")), "components")
    own = alias_free(keyed, key, "doc_id").select(F.col(key).alias("key"), F.col("doc_id").cast("long"))
    # a row that is alone in its component needs no verdict; the others are few and small
    others = table.where("key <> component")
    roots = others.select("component").distinct().select(F.col("component").alias("key"), "component")  # a component bears the key of one of its rows
    grouped = others.unionByName(roots).join(own, "key")
    best = grouped.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "key")).alias("best")).select(F.col("best.key").alias("key"))
    dropped = scratch.keep(grouped.join(best, "key", "left_anti").select("key"), "dropped")
    spot = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS))
    marks = scratch.keep(marks_of(dropped, spot("key")), "marks").toDF(f"bucket{free}", f"bits{free}")

    at = spot(key)
    rows = keyed.join(F.broadcast(marks), F.bitmap_bucket_number(at) == F.col(f"bucket{free}"), "left")
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring(f"bits{free}", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8))) == 1, F.lit(False))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    open_rows = rows.where(marked).join(dropped.withColumnRenamed("key", f"dropped{free}"), F.col(key) == F.col(f"dropped{free}"), "left_anti")
    return rows.where(~marked).select(*columns).unionAll(open_rows.select(*columns))
