"""Content-addressed token store.

Token ids are cut into chunks where a rolling hash of the last ``WINDOW`` ids hits a boundary, so equal passages give
equal chunks wherever they stand. The store is a directory with three tables:

``chunks``    digest (SHA-256 of the payload), n_ids, payload: ids as little-endian unsigned 16- or 32-bit integers; each
              distinct chunk once.
``recipes``   doc_id, start, n_tokens, root, digests, in files of ascending doc_id (``shard`` numbers the files):
              the chunks of a document in order, its Merkle root, and the ids of all documents before it.
``manifest``  shard, first_start, n_documents, n_tokens, root: Merkle root over the recipe roots of each shard.

Reading verifies every payload against its digest, every recipe against its root, and the recipes of every shard against the manifest, so
a lost, doubled or changed row raises. ``read_documents`` rebuilds the
id arrays; ``read_checksums`` rebuilds each document's CRC-32 from the chunks' own ones, combined in recipe
order, so that no payload is shuffled.

Defined results: a null or empty text is its end id alone; rows with one doc_id are ordered by Merkle root, so equal rows stay
interchangeable; a null doc_id sorts first; an empty table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditgrove.llm.shared import Scratch, alias_free, blocks, bound_batches, emit, mix, strings
from auditgrove.llm.tokens import default_path, encoder

WINDOW, LEAST, MASK, MOST, END_ID = 16, 64, 255, 2048, 2
#: Text encoded at a time: a longer block repeats fewer words.
ENCODE_BYTES = 8 << 20
#: Digests that a task remembers so as to send each chunk once.
KNOWN_DIGESTS = 300_000
#: Multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ROWS = pa.schema([("kind", pa.string()), ("digest", pa.binary()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("root", pa.binary()), ("digests", pa.list_(pa.binary()))])
DDL = "kind string, digest binary, n_ids long, payload binary, doc_id long, n_tokens long, root binary, digests array<binary>"
SALT = mix(np.arange(1, (1 << 16) + 1, dtype=np.uint64))


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a lone node moves up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        paired = [hashlib.sha256(b"\1" + a + b).digest() for a, b in zip(level[::2], level[1::2])]
        level = paired + level[len(paired) * 2 :]
    return level[0]


class Merkle:
    """Merkle root of leaves that come one by one; holds a node per level. The root is that of ``merkle_root``."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []  # (level, hash), levels falling

    def add(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.nodes and self.nodes[-1][0] == level:
            level, node = level + 1, hashlib.sha256(b"\1" + self.nodes.pop()[1] + node).digest()
        self.nodes.append((level, node))

    def root(self) -> bytes:
        if not self.nodes:
            return hashlib.sha256(b"").digest()
        node = self.nodes[-1][1]
        for _, left in reversed(self.nodes[:-1]):
            node = hashlib.sha256(b"\1" + left + node).digest()
        return node


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i below size."""
    up, down = np.full(size, BASE, np.uint64), np.full(size, INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def boundaries(ids: np.ndarray) -> np.ndarray:
    """Flags of the ids after which the rolling hash would cut.

    The hash of the WINDOW ids up to place i, sum of salt * BASE**distance, is BASE**i times a difference of prefix sums.
    """
    n = len(ids)
    up, down = (p[:n] for p in powers(1 << max(16, (n - 1).bit_length() if n else 0)))
    h = SALT[ids & 0xFFFF]
    h *= down
    np.cumsum(h, out=h)
    h[WINDOW:] -= h[:-WINDOW].copy() if n > WINDOW else 0
    h *= up
    return (h >> np.uint64(40)) & np.uint64(MASK) == 0


def cuts(candidates: np.ndarray, lo: int, hi: int) -> list[int]:
    """Chunk ends of the document at lo..hi: candidates at least LEAST ids apart, MOST ids at most."""
    ends, at = [], lo
    for c in candidates.tolist():
        while c - at > MOST:
            at += MOST
            ends.append(at)
        if c - at >= LEAST and hi - c >= LEAST:
            at = c
            ends.append(at)
    while hi - at > MOST:
        at += MOST
        ends.append(at)
    return [*ends, hi]


def encoded(docs: DataFrame, path: str, end: int) -> DataFrame:
    """Chunk rows and recipe rows. A task sends each chunk once, as long as its memory of digests reaches, so a passage of many documents
    comes at most about once from every task."""
    bound_batches(docs.sparkSession)

    def run(batches):
        own, known = encoder(path), set()
        for table in blocks(batches, "text", ENCODE_BYTES):
            ids, first = own.encode(strings(table, "text"), end)
            wide = "<u2" if own.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else "<u4"
            marks = np.flatnonzero(boundaries(ids)) + 1
            chunks, recipes = {}, {"doc_id": table.column("doc_id").to_pylist(), "n_tokens": np.diff(first).tolist(), "root": [], "digests": []}
            raw, size = ids.astype(wide).tobytes(), int(wide[-1])
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                inner = marks[np.searchsorted(marks, lo + WINDOW) : np.searchsorted(marks, hi)]
                at, leaves = lo, []
                for upto in cuts(inner, lo, hi):
                    payload = raw[at * size : upto * size]
                    digest = hashlib.sha256(payload).digest()
                    if digest not in known:
                        known.add(digest)
                        chunks[digest] = (upto - at, payload)
                    leaves.append(digest)
                    at = upto
                recipes["digests"].append(leaves)
                recipes["root"].append(merkle_root(leaves))
            n, m = len(chunks), len(recipes["root"])
            if len(known) > KNOWN_DIGESTS:
                known.clear()
            none = lambda k: [None] * k
            rows = {"kind": ["chunks"] * n + ["recipes"] * m, "digest": [*chunks, *none(m)], "n_ids": [c[0] for c in chunks.values()] + none(m), "payload": [c[1] for c in chunks.values()] + none(m)}
            yield emit(rows | {c: none(n) + v for c, v in recipes.items()}, ROWS)

    source = alias_free(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return source.mapInArrow(run, DDL)


def write_store(docs: DataFrame, root: str, path: str | None = None, end: int = END_ID) -> None:
    """Write the store; texts are encoded once and each payload is shuffled once."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "token-store")
    rows = encoded(docs, path or default_path(), end)
    # chunks meet by digest, recipes are spread; the first of equal chunks stays
    key = F.coalesce("digest", F.concat(F.col("root"), F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "utf-8")))
    dealt = rows.repartition(key).sortWithinPartitions("kind", "digest")

    def unique(batches):
        last = None
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            keep = [d is None or d != p for d, p in zip(digests, [last, *digests[:-1]])]
            last = digests[-1] if digests else last
            yield batch.filter(pa.array(keep, pa.bool_()))

    raw = scratch.path("raw")
    dealt.mapInArrow(unique, DDL).write.partitionBy("kind").option("compression", "zstd").parquet(raw)
    every = spark.read.schema(rows.schema).parquet(raw)
    ordered = every.where("kind = 'recipes'").select("doc_id", "n_tokens", "root", "digests").repartitionByRange("doc_id", "root").sortWithinPartitions("doc_id", "root")
    numbered = ordered.withColumn("shard", F.spark_partition_id().cast("long"))
    fields = "doc_id long, n_tokens long, root binary, digests array<binary>, shard long, local_start long, n_documents long"

    def offsets(batches):
        """The recipes with the ids before them in their shard, then one row for the shard: documents, tokens, Merkle root."""
        at, count, tree, last = 0, 0, Merkle(), None
        for batch in batches:
            n = batch.column("n_tokens").to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at + np.cumsum(n) - n, pa.int64()), pa.nulls(batch.num_rows, pa.int64())], names=[*batch.schema.names, "local_start", "n_documents"])
            at, count, last = at + int(n.sum()), count + batch.num_rows, batch if batch.num_rows else last
            for root in batch.column("root").to_pylist():
                tree.add(root)
        if count:
            row = {"doc_id": [None], "n_tokens": [at], "root": [tree.root()], "digests": [[]], "shard": last.column("shard").slice(0, 1), "local_start": [None], "n_documents": [count]}
            whole = emit(row, pa.schema([*last.schema, ("local_start", pa.int64()), ("n_documents", pa.int64())]))
            yield pa.RecordBatch.from_arrays(whole.columns, names=whole.schema.names)

    placed = scratch.keep(numbered.mapInArrow(offsets, fields), "placed")
    before = F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    # a row per range partition: the number of shuffle partitions bounds it, whatever the corpus
    manifest = scratch.keep(placed.where("n_documents is not null").select("shard", F.coalesce(before, F.lit(0)).alias("first_start"), "n_documents", "n_tokens", "root"), "manifest-rows")
    manifest.write.parquet(f"{root}/manifest")
    recipes = placed.where("n_documents is null").join(F.broadcast(manifest.select("shard", "first_start")), "shard")
    recipes.select("shard", "doc_id", (F.col("first_start") + F.col("local_start")).alias("start"), "n_tokens", "root", "digests").write.option("compression", "zstd").parquet(f"{root}/recipes")
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    source = jvm.Path(f"{raw}/kind=chunks")
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(source):
        files.rename(source, jvm.Path(f"{root}/chunks"))  # chunk files are final as they are
    else:
        every.where("kind = 'chunks'").select("digest", "n_ids", "payload").write.parquet(f"{root}/chunks")
    scratch.drop(placed)


def check_manifest(spark: SparkSession, root: str) -> None:
    """Recompute documents, tokens and Merkle root of every shard from its recipes; a difference from the manifest raises.

    A shard is one range partition of the recipes, so its digests fit a task as they did when they were sorted.
    """

    def run(batches):
        shard, tree, count, tokens = None, Merkle(), 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([count], pa.int64()), pa.array([tokens], pa.int64()), pa.array([tree.root()], pa.binary())], names=["shard", "n_documents", "n_tokens", "root"])

        for batch in batches:
            for s, r, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "root", "n_tokens"))):
                if s != shard:
                    if count:
                        yield row()
                    shard, tree, count, tokens = s, Merkle(), 0, 0
                tree.add(r)
                count, tokens = count + 1, tokens + n
        if count:
            yield row()

    bound_batches(spark)
    names = ("n_documents", "n_tokens", "root")
    dealt = _recipes(spark, root).select("shard", "start", "root", "n_tokens").repartition("shard").sortWithinPartitions("shard", "start")
    found = dealt.mapInArrow(run, "shard long, n_documents long, n_tokens long, root binary").select("shard", *[F.col(c).alias(f"{c}_") for c in names])
    manifest = spark.read.schema("shard long, first_start long, n_documents long, n_tokens long, root binary").parquet(f"{root}/manifest")
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_"))
    if manifest.join(found, "shard", "full_outer").where(~same).limit(1).count():
        raise ValueError("the recipes do not match the manifest")


def _chunks(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("digest binary, n_ids long, payload binary").parquet(f"{root}/chunks")


def _recipes(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema("shard long, doc_id long, start long, n_tokens long, root binary, digests array<binary>").parquet(f"{root}/recipes")


def ids_of(payload: bytes, n_ids: int) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if len(payload) == 2 * n_ids else "<u4").astype("<u4")


def read_checksums(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from verified chunks; a broken chunk, recipe or manifest raises."""
    check_manifest(spark, root)
    bound_batches(spark)

    def check(batches):
        for batch in batches:
            crcs = []
            for d, n, p in zip(*(batch.column(c).to_pylist() for c in ("digest", "n_ids", "payload"))):
                if hashlib.sha256(p).digest() != d:
                    raise ValueError("a chunk does not match its digest")
                crcs.append(zlib.crc32(ids_of(p, n).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_ids"), pa.array(crcs, pa.int64())], names=["digest", "n_ids", "crc"])

    crcs = _chunks(spark, root).mapInArrow(check, "digest binary, n_ids long, crc long")
    recipes = _recipes(spark, root)
    # documents with one recipe share one reconstruction
    wanted = recipes.groupBy("root").agg(F.first("digests").alias("digests"), F.first("n_tokens").alias("n_tokens"))
    parts = wanted.select("root", "n_tokens", F.posexplode("digests").alias("place", "digest")).join(crcs, "digest", "left")
    rebuilt = parts.groupBy("root", "n_tokens").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_ids", "crc"))).alias("parts"))

    def combine(batches):
        zeros = bytes(4 * MOST)
        for batch in batches:
            out = []
            for doc_root, n_tokens, chunks in zip(batch.column("root").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("parts").to_pylist()):
                if merkle_root([c["digest"] for c in chunks]) != doc_root or sum(c["n_ids"] or 0 for c in chunks) != n_tokens:
                    raise ValueError("a document does not match its recipe")
                crc = 0
                for c in chunks:  # crc(a + b) from crc(a), crc(b) and len(b): a CRC is linear
                    gap = zeros[: 4 * c["n_ids"]]
                    crc = zlib.crc32(gap, crc) ^ zlib.crc32(gap) ^ c["crc"]
                out.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column("root"), pa.array(out, pa.int64())], names=["root", "ids_crc32"])

    checked = rebuilt.mapInArrow(combine, "root binary, ids_crc32 long")
    return recipes.select("doc_id", "start", "n_tokens", "root").join(checked, "root").select("doc_id", "start", "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """doc_id, start, and the ids of every document, rebuilt from its chunks and verified."""
    check_manifest(spark, root)
    parts = _recipes(spark, root).select("doc_id", "start", "n_tokens", "root", F.posexplode("digests").alias("place", "digest"))
    whole = parts.join(_chunks(spark, root), "digest").groupBy("doc_id", "start", "n_tokens", "root").agg(F.array_sort(F.collect_list(F.struct("place", "digest", "n_ids", "payload"))).alias("parts"))
    bound_batches(spark)

    def rebuild(batches):
        for batch in batches:
            ids = []
            for n, of, chunks in zip(batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), batch.column("parts").to_pylist()):
                if merkle_root([c["digest"] for c in chunks]) != of or any(hashlib.sha256(c["payload"]).digest() != c["digest"] for c in chunks) or sum(c["n_ids"] for c in chunks) != n:
                    raise ValueError("a document does not match its recipe")
                ids.append(np.concatenate([ids_of(c["payload"], c["n_ids"]) for c in chunks]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return whole.mapInArrow(rebuild, "doc_id long, start long, ids array<int>")
