"""Helpers common to the corpus operators: shared scratch tables, Arrow text blocks, word hashing."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

from auditgrove.functions.storage import shared_folder

#: Text held by one block inside a task; a longer single text forms a block of its own.
BLOCK_BYTES = 4 << 20
#: Bytes and rows that Spark hands to a Python worker at once; the row that passes the bytes is the batch's last.
ARROW_BYTES, ARROW_ROWS = 4 << 20, 10_000


def bound_batches(spark: SparkSession) -> None:
    """Bound what Spark hands to a Python worker at once, by bytes. Every operator sets the same values, so frames that are
    built first and run later are bounded alike."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


class Scratch:
    """Tables written below ``spark.checkpoint.dir``: they cut lineage and survive lost executors.

    The directory is read from the session; only a local session may do without it.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = shared_folder(spark, label)
        self.count = 0

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write df as Parquet, with further options of the writer if given, and return it reread."""
        path = self.path(name)
        df.write.options(**{"compression": "zstd"} | options).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def release(self) -> None:
        """Have the driver collect frames that are no longer used: their shuffle files go only then."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables holding about ``limit`` bytes of ``column``."""
    held, size = [], 0
    for batch in batches:
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        first, ends = 0, np.cumsum(lengths)
        while first < batch.num_rows:
            done = ends[first - 1] if first else 0
            upto = max(first + 1, int(np.searchsorted(ends, done + limit - size, side="right")))
            held.append(batch.slice(first, upto - first))
            size += int(ends[upto - 1] - done)
            first = upto
            if size >= limit or first < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def strings(table: pa.Table, column: str) -> pa.Array:
    """The column as one Arrow string array in which null is the empty text."""
    got = table.column(column).combine_chunks()
    got = got.combine_chunks() if isinstance(got, pa.ChunkedArray) else got
    return pc.fill_null(got.cast(pa.string()), "")


def split_words(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """ASCII-white-space words of each text: words per text, codes of all words in order, their dictionary."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(parts).to_numpy(zero_copy_only=False))
    empty = pc.index(coded.dictionary, "").as_py()
    if empty >= 0:
        owner, codes = owner[codes != empty], codes[codes != empty]
    return np.bincount(owner, minlength=len(texts)), codes, coded.dictionary


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter(map(digest, values.cast(pa.binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(values))


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        out = out * np.uint64(0x9E3779B97F4A7C15) + values[j : j + n]
    return mix(out)


def emit(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch with exactly the given schema."""
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) if not isinstance(rows[f.name], (pa.Array, pa.ChunkedArray)) else flat(rows[f.name], f.type) for f in schema], schema=schema)


class Bitmap:
    """A set of 64-bit hashes by their bits after the sign; absent members may be reported, present ones always are."""

    def __init__(self, bits: int, cells: np.ndarray | None = None):
        self.bits, self.cells = bits, np.zeros(1 << (bits - 3), np.uint8) if cells is None else cells

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = (hashes << np.uint64(1)) >> np.uint64(64 - self.bits)
        return (self.cells[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap_bits(n: int, least: int, most: int) -> int:
    """Bits (as a power of two) of a bitmap of n members: eight a member and more, within the bounds."""
    return min(most, max(least, int(n * 8).bit_length()))


def bitmap_of(hashes: DataFrame, n: int, most: int) -> Bitmap:
    """Bitmap of the long column ``h`` with about n members. The driver gets its cells of 32 bits, at most 2 ** (most - 5) rows, whatever n is."""
    from pyspark.sql import functions as F

    bits = bitmap_bits(n, 20, most)
    at = F.shiftrightunsigned(F.shiftleft("h", 1), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 32).cast("int"))
    cells = hashes.groupBy(F.shiftright(at, 5).alias("cell")).agg(F.bit_or(one).alias("set")).toArrow()
    out = np.zeros(1 << (bits - 5), np.uint32)
    out[cells["cell"].to_numpy()] = cells["set"].to_numpy().astype(np.uint32)
    return Bitmap(bits, out.view(np.uint8))


def flat(column: pa.Array | pa.ChunkedArray, kind: pa.DataType) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column if column.type == kind else column.cast(kind)


def alias_free(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, missing ones as null; other columns, whatever their names, are left behind."""
    from pyspark.sql import functions as F

    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[n.lower()]}`").alias(n) if n.lower() in have else F.lit(None).alias(n) for n in names])
