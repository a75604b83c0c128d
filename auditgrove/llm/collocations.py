"""Collocations: phrases of two to four words that occur often for what their parts occur, per language.

Counting is by direct-address tiling, one length after the other. Words are ranked by frequency (``HEAD`` at most); a pair of ranked words is a cell of a tile of ``TILE`` x
``TILE``, and a tile that a block of text fills well is counted by one dense ``bincount``. The other pairs of the block are counted as sorted
coordinates. Pairs that turn out frequent are ranked anew and take the place of the first word, so triples, and then quadruples, are again pairs of
a ranked phrase and a ranked word. A longer phrase is counted only where both phrases inside it, without its last and without its first word, are frequent.

Scale: what tasks are given is bounded. Ranked words and phrases are at most ``HEAD`` (of at most ``HEAD_BYTES`` each); a frequent word or phrase beyond them is known by a hash,
and a bitmap of at most ``MOST_BITS`` bits tells which are frequent. A bitmap may let too much through; such phrases are counted and then found to be rare, so
results do not depend on it. Words beyond the head are told apart by a 64-bit hash with a salt under which no two words of the whole vocabulary meet. Rows of phrase counts are summed per block
before they move. A language of any size is no group anywhere: the final ranking is cut in every task before it meets.

Defined results: null texts are empty; a null lang is ``und``, like the lang of that name; repeated rows count each; equal scores and counts are ordered by the
phrase's bytes; a language without a candidate has no row; an empty table gives no row; extra columns are ignored. All arithmetic is on integers or exact decimals.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditgrove.llm.shared import Bitmap, Scratch, alias_free, bitmap_of, blocks, bound_batches, mix, strings

LEAST, LONGEST, TOP = 30, 4, 2000
NESTED_PERCENT, SCALE = 80, 2_000_000
#: Ranked words or phrases of one length; UTF-8 bytes of a ranked word with its lang; side of a tile; the part of a tile's cells that must be met for the dense count.
HEAD, HEAD_BYTES, TILE, DENSE = 1 << 18, 64, 256, 8
BLOCK, MOST_BITS = 6 << 20, 27
#: Rows that a task hands to Spark at once.
SENT_ROWS = 1 << 16
#: Parts of a language that are ranked apart before the best of each meet.
SALTS = 128
WORD, SPACE, BREAK = 0, 1, 2
KINDS = np.zeros(256, np.uint8)
KINDS[list(b" \t")] = SPACE
KINDS[list(b".,;:!?\n\x0b\x0c\r")] = BREAK
COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
SIGN = np.uint64(1 << 63)


class Pieces:
    """The words of one block: per occurrence a code into ``keys`` (lang, line feed, word), and the piece it lies in."""

    def __init__(self, block: pa.Table):
        texts = pc.ascii_lower(strings(block, "text"))
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        begins = (offsets - offsets[0]).astype(np.int64)
        heads = begins[:-1][begins[:-1] < begins[1:]]
        kinds = KINDS[data]
        word = kinds == WORD
        before, after = np.zeros(len(word), bool), np.zeros(len(word), bool)
        before[1:], after[:-1] = word[:-1], word[1:]
        before[heads] = False
        after[heads[heads > 0] - 1] = False
        first, last = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after)
        row = np.searchsorted(begins[1:], first, side="right")
        self.piece = np.cumsum(kinds == BREAK, dtype=np.int64)[first] + row
        ends = np.concatenate(([0], np.cumsum(last - first + 1))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends), pa.py_buffer(data[word].tobytes())).dictionary_encode()
        langs = strings(block, "lang").dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        both = lang * max(len(words.dictionary), 1) + words.indices.to_numpy(zero_copy_only=False)
        met, self.codes = np.unique(both, return_inverse=True)
        at = np.divmod(met, max(len(words.dictionary), 1))
        self.lang, self.word = langs.dictionary.take(pa.array(at[0])), words.dictionary.take(pa.array(at[1]))

    def keys(self) -> pa.Array:
        return pc.binary_join_element_wise(self.lang, self.word, "\n")


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches, "text", BLOCK):
        p = Pieces(block)
        yield pa.RecordBatch.from_arrays([p.lang, p.word, pa.array(np.bincount(p.codes, minlength=len(p.word)), pa.int64())], schema=COUNTS)


class Lexicon:
    """Ids of words: the rank of a ranked word, else a hash with the sign bit; and which words are frequent."""

    def __init__(self, head: pa.Array, salt: int, tail: Bitmap | None):
        self.head, self.salt, self.tail = head, salt, tail

    def look(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Id and whether it is frequent (never false for a frequent one)."""
        rank = pc.index_in(keys, self.head)
        ids, known = pc.fill_null(rank.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).copy(), rank.is_valid().to_numpy(zero_copy_only=False).copy()
        if self.tail is not None:
            at, digest, salt = np.flatnonzero(~known), xxhash.xxh64_intdigest, f"{self.salt}\n"
            h = np.fromiter((digest(salt + k, 42) for k in keys.take(pa.array(at)).to_pylist()), np.uint64, len(at))
            known[at] = self.tail.has(h | SIGN)
            ids[at] = (h | SIGN).view(np.int64)
        return ids, known


class Phrases:
    """Frequent phrases of one length: ranks of the ``head`` (rows of word ids), a bitmap for the rest."""

    def __init__(self, head: np.ndarray, tail: Bitmap | None):
        h = phrase_hash(head)
        order = np.argsort(h, kind="stable")
        self.head, self.order, self.hashes, self.tail = head, order, h[order], tail

    def look(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (or -1) and whether it is frequent (never false for a frequent one)."""
        h = phrase_hash(ids)
        rank, known = np.full(len(ids), -1, np.int64), np.zeros(len(ids), bool)
        if len(self.head):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            there = (self.head[self.order[at]] == ids).all(axis=1)
            rank[there], known[there] = self.order[at][there], True
        if self.tail is not None:
            known |= self.tail.has(h)
        return rank, known


def phrase_hash(ids: np.ndarray) -> np.ndarray:
    h = np.zeros(len(ids), np.uint64)
    for k in range(ids.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + mix(ids[:, k].astype(np.int64).view(np.uint64) + np.uint64(k + 1)))
    return h


def tiled_counts(left: np.ndarray, right: np.ndarray, left_rank: np.ndarray, right_rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of pairs of codes: left code, right code, count. ``*_rank``: per code, -1 for none."""
    a, b = left_rank[left], right_rank[right]
    across = (1 + max(left_rank.max(initial=0), right_rank.max(initial=0))) // TILE + 1
    tile = np.where((a >= 0) & (b >= 0), a // TILE * across + b // TILE, -1)
    found = []
    for t in np.flatnonzero(np.bincount(tile + 1)[1:] >= TILE * TILE // DENSE).tolist():
        mine = tile == t
        cells = np.bincount(a[mine] % TILE * TILE + b[mine] % TILE, minlength=TILE * TILE)
        at = np.flatnonzero(cells)
        code = [np.full(TILE, -1, np.int64), np.full(TILE, -1, np.int64)]
        for c, rank, number in zip(code, (left_rank, right_rank), divmod(t, across)):
            own = np.flatnonzero((rank >= 0) & (rank // TILE == number))
            c[rank[own] % TILE] = own
        found.append((code[0][at // TILE], code[1][at % TILE], cells[at]))
        tile[mine] = -2
    rest = tile > -2
    key, n = np.unique(left[rest] * len(right_rank) + right[rest], return_counts=True)
    found.append((*np.divmod(key, max(len(right_rank), 1)), n))
    return tuple(np.concatenate(x) for x in zip(*found))


def count_phrases(length: int, lexicon, shorter: list) -> Callable:
    """Counts of phrases of ``length`` words in each block; ``shorter``: the frequent phrases of 2 to length - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text", BLOCK):
            p = Pieces(block)
            ids, live = lexicon.value.look(p.keys())
            unit, rank, words, live = p.codes, np.maximum(ids, -1), ids[:, None], live[p.codes]
            for m in range(2, length + 1):
                at = np.flatnonzero(live[: 1 - m] & live[1 : len(live) - m + 2] & (p.piece[: 1 - m] == p.piece[m - 1 :])) if len(live) >= m else np.empty(0, np.int64)
                if m == length:
                    left, right, n = tiled_counts(unit[at], p.codes[at + m - 1], rank, np.maximum(ids, -1))
                    for lo in range(0, len(n), SENT_ROWS):
                        first, last = words[left[lo : lo + SENT_ROWS]], ids[right[lo : lo + SENT_ROWS]]
                        yield pa.RecordBatch.from_arrays([*[pa.array(first[:, k]) for k in range(length - 1)], pa.array(last), pa.array(n[lo : lo + SENT_ROWS], pa.int64())], names=[*[f"w{k + 1}" for k in range(length)], "n"])
                    break
                met, inverse = np.unique(unit[at] * len(ids) + p.codes[at + m - 1], return_inverse=True)
                left, right = np.divmod(met, max(len(ids), 1))
                words = np.column_stack((words[left], ids[right]))
                rank, frequent = shorter[m - 2].value.look(words)
                unit, live = np.zeros(len(p.codes), np.int64), np.zeros(len(p.codes), bool)
                unit[at], live[at] = inverse, frequent[inverse]

    return run


def head_of(counts: DataFrame, *columns: str) -> tuple[pa.Table, DataFrame]:
    """The most frequent rows, ``HEAD`` at most, in descending order of ``n``; and a frame that says of every row whether it is among them (``ranked``).

    Rows are cut by steps of an eighth of an octave of n, whose histogram is a few hundred rows; all rows of a step are taken or none.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    histogram = counts.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect()
    cut, total = 1 << 30, 0
    for r in histogram:
        total += r["count"]
        if r["step"] is not None and total <= HEAD:
            cut = r["step"]
        else:
            break
    marked = counts.withColumn("ranked", F.coalesce(step >= cut, F.lit(False)))
    head = marked.where("ranked").select(*columns, "n").toArrow()
    return head.sort_by([("n", "descending"), *[(c, "ascending") for c in columns]]), marked


def free_salt(keys: DataFrame) -> int:
    """The first salt under which no two distinct keys have one hash."""
    salt = 0
    while keys.groupBy(salted(salt).alias("h")).count().where("count > 1").limit(1).count():
        salt += 1
    return salt


def salted(salt: int):
    """The id of a ``key`` beyond the head."""
    return F.xxhash64(F.concat(F.lit(f"{salt}\n"), F.col("key"))).bitwiseOR(F.lit(-(1 << 63)))


def frequent_words(counts: DataFrame, least: int, scratch: Scratch) -> tuple[Lexicon, DataFrame]:
    """The lexicon, and ``id``, ``lang``, ``word``, ``n`` of the frequent words."""
    spark = counts.sparkSession
    keyed = counts.withColumn("key", F.concat("lang", F.lit("\n"), "word"))
    frequent = keyed.where(F.col("n") >= least)
    short, marked = head_of(frequent.withColumn("n", F.when(F.octet_length("key") <= HEAD_BYTES, F.col("n"))), "key")
    keys = short["key"].combine_chunks()
    keys = keys if isinstance(keys, pa.StringArray) else pa.array(keys.to_pylist(), pa.string())
    ranks = spark.createDataFrame(pa.table({"key": keys, "rank": pa.array(np.arange(len(keys)))}), "key string, rank long")
    beyond = marked.where("not ranked").count()
    salt = free_salt(keyed.select("key")) if beyond else 0
    ids = frequent.join(F.broadcast(ranks), "key", "left").select(F.coalesce("rank", salted(salt)).alias("id"), "lang", "word", "n")
    ids = scratch.keep(ids, "frequent")
    tail = None
    if beyond:
        beyond_head = ids.where("id < 0").select(F.concat("lang", F.lit("\n"), "word").alias("key"))
        tail = bitmap_of(beyond_head.select(salted(salt).alias("h")), beyond, MOST_BITS)
    return Lexicon(keys, salt, tail), ids


def frequent_phrases(counts: DataFrame, length: int) -> Phrases:
    columns = [f"w{k + 1}" for k in range(length)]
    head, marked = head_of(counts, *columns)
    beyond = marked.where("not ranked")
    n = beyond.count()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.column_stack([batch.column(c).to_numpy() for c in columns])
            yield pa.RecordBatch.from_arrays([pa.array(phrase_hash(ids).view(np.int64))], names=["h"])

    tail = bitmap_of(beyond.select(*columns).mapInArrow(hashes, "h long"), n, MOST_BITS) if n else None
    return Phrases(np.column_stack([head[c].to_numpy() for c in columns]).astype(np.int64).reshape(-1, length), tail)


def part(first: int, last: int):
    return F.array(*[F.col(f"w{k}") for k in range(first, last + 1)])


def scored(words: DataFrame, phrases: dict[int, DataFrame], scratch: Scratch) -> DataFrame:
    """``phrase`` (word ids), ``lang``, ``a``, ``l``, ``r`` and ``score`` of every candidate that no longer one replaces."""
    parts = words.select(F.array("id").alias("part"), F.col("n").alias("f"), "lang")
    for k, df in phrases.items():
        if k < max(phrases):
            parts = parts.unionByName(df.select(part(1, k).alias("part"), F.col("n").alias("f"), F.lit(None).cast("string").alias("lang")))
    cuts, inside = [], []
    for k, df in phrases.items():
        cuts += [df.select(part(1, k).alias("phrase"), F.col("n").alias("a"), F.lit(c).alias("cut"), part(1, c).alias("left"), part(c + 1, k).alias("right")) for c in range(1, k)]
        inside += [df.select(part(i, i + m - 1).alias("phrase"), "n") for m in range(2, k) for i in range(1, k - m + 2)]
    cuts = reduce(DataFrame.unionByName, cuts).join(parts.select(F.col("part").alias("left"), F.col("f").alias("l"), "lang"), "left")
    cuts = cuts.join(parts.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"cast((cast(a as decimal(20, 0)) * {SCALE}) div (l + r) as bigint)")
    best = cuts.groupBy("phrase").agg(F.first("a").alias("a"), F.max("lang").alias("lang"), F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    best = best.select("phrase", "a", "lang", "best.*")
    if inside:
        longer = reduce(DataFrame.unionByName, inside).groupBy("phrase").agg(F.max("n").alias("longer"))
        best = best.join(longer, "phrase", "left").where(f"longer is null or cast(longer as decimal(20, 0)) * 100 < cast(a as decimal(20, 0)) * {NESTED_PERCENT}").drop("longer")
    return scratch.keep(best, "scored")


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """Each lang's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more: lang, rank, phrase, a, l, r, n, score."""
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "collocations")
    texts = alias_free(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    counts = texts.mapInArrow(count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = scratch.keep(counts, "words")
    lexicon, words = frequent_words(counts, least, scratch)
    shared, shorter, phrases = spark.sparkContext.broadcast(lexicon), [], {}
    for k in range(2, longest + 1):
        columns = [f"w{i + 1}" for i in range(k)]
        rows = texts.mapInArrow(count_phrases(k, shared, list(shorter)), ", ".join(f"{c} long" for c in columns) + ", n long")
        phrases[k] = scratch.keep(rows.groupBy(*columns).agg(F.sum("n").alias("n")).where(F.col("n") >= least), f"phrases{k}")
        if k < longest:
            shorter.append(spark.sparkContext.broadcast(frequent_phrases(phrases[k], k)))
    best = scored(words, phrases, scratch)
    by_score = [F.desc("score"), F.desc("a")]
    best = best.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for group in (["lang", "salt"], ["lang"]):
        best = best.withColumn("place", F.rank().over(Window.partitionBy(*group).orderBy(*by_score))).where(F.col("place") <= top)
    best = best.drop("place", "salt")
    # the texts of the phrases that are left, ties at the end included
    spelt = best.select("phrase", F.posexplode("phrase").alias("at", "id")).join(words.select("id", "word"), "id")
    spelt = spelt.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("at", "word"))).alias("words"))
    named = best.join(spelt.select("phrase", F.array_join("words.word", " ").alias("text")), "phrase")
    placed = named.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by_score, "text")).cast("long")).where(F.col("rank") <= top)
    totals = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    return placed.join(totals, "lang").select("lang", "rank", F.col("text").alias("phrase"), "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k),
f AS MATERIALIZED (SELECT lang, k, g, count(*) AS f FROM g GROUP BY lang, k, g HAVING count(*) >= 30),
c AS MATERIALIZED (SELECT lang, g, k, f, string_split(g, ' ') AS w FROM f WHERE k >= 2),
u AS (SELECT lang, g, k, f AS a, cut, array_to_string(w[1:cut], ' ') AS lg, array_to_string(w[cut + 1:], ' ') AS rg FROM c, (SELECT unnest([1, 2, 3]) AS cut) WHERE cut < k),
s AS (SELECT u.lang, u.g, u.a, cut, x.f AS l, y.f AS r, ((2000000::hugeint * u.a) // (x.f + y.f))::bigint AS score FROM u JOIN f x ON x.lang = u.lang AND x.g = u.lg JOIN f y ON y.lang = u.lang AND y.g = u.rg),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
i AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS g, f FROM c, (SELECT unnest([2, 3]) AS m), (SELECT unnest([1, 2, 3]) AS i) WHERE m < k AND i + m - 1 <= k),
o AS (SELECT lang, g, max(f) AS f FROM i GROUP BY lang, g),
r AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN o ON o.lang = b.lang AND o.g = b.g WHERE o.f IS NULL OR 100::hugeint * o.f < 80::hugeint * a)
SELECT r.lang, row_number() OVER (PARTITION BY r.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::bigint AS n, score
FROM r JOIN t ON t.lang = r.lang QUALIFY rank <= 2000
"""
