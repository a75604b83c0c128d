"""Document operators against brute force, on small tables with nulls, empty, long, tied and repeated rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrove.llm import decontam, lm_bloom, near_dup, packing, quality, token_store
from auditgrove.llm.shared import Scratch
from auditgrove.llm.tokens import default_path

from .common import DOCS, LOWER, documents, sample_texts, words

#: An item without id is found, but not named.
ITEMS = [(None, "one two three"), (1, "one two three"), (2, " ".join(f"w{i}" for i in range(14))), (3, None), (4, ""), (5, "one two three")]


def bench_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_hits(text, items):
    own, hit, found = bench_words(text), set(), set()
    for item, t in items:
        q = bench_words(t)
        for k in range(max(1, len(q) - 9) if q else 0):
            w = q[k : k + 10]
            for p in range(len(own) - len(w) + 1):
                if own[p : p + len(w)] == w:
                    hit |= set(range(p, p + len(w)))
                    found |= {str(item)} - {"None"}
    return len(own), len(hit), sorted(found)


@pytest.mark.parametrize("block", [decontam.BENCH_BYTES, 70])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BENCH_BYTES", block)
    texts = sample_texts() + ["x " + " ".join(f"W{i}," for i in range(3, 14)) + " y One-two-three", "one two one two three two three"]
    docs = documents(spark, texts, extra=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontam.contamination(docs, bench).collect()
    assert len(got) == len(texts) + 1  # the repeated row too
    by_id = {r["doc_id"]: r for r in got}
    for i, t in enumerate(texts):
        n, hit, items = brute_hits(t, ITEMS)
        r = by_id[i * 3]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(items), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_span_removal_keeps_clean_rows_and_recounts(spark):
    docs = documents(spark, ["clean text stays", "x one two three, y", "one two three", None], extra=True)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.remove_spans(docs, bench).collect()}
    assert got[0]["text"] == "clean text stays" and 6 not in got and got[9]["text"] is None
    assert got[3]["text"] == "x , y" and got[3]["n_chars"] == 5 and got[3]["kept"] == "clash"


@pytest.mark.parametrize("block", [decontam.BENCH_BYTES, 70])
def test_rows_that_share_an_id_keep_their_own_spans(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BENCH_BYTES", block)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    leak = " ".join(f"w{i}" for i in range(14))
    rows = [(1, "x one two three"), (1, "one two three x"), (1, "clean words stay here"), (None, f"a {leak} b"), (None, "one two three c"), (2, "same one two three"), (2, "same one two three"), (3, leak), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("starts", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("whole", F.lit("clash"))
    got = decontam.contamination(docs, bench).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"]) for r in got) == sorted((d or 0, n, hit, len(items)) for d, t in rows for n, hit, items in [brute_hits(t, ITEMS)])
    assert sorted(r["starts"] for r in got if r["doc_id"] == 1) == [[], [0], [1]]
    left = decontam.remove_spans(docs, bench)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left.collect()) == [(0, "a b"), (0, "c"), (1, "clean words stay here"), (1, "x"), (1, "x"), (2, "same"), (2, "same"), (4, "")]


@pytest.mark.parametrize("block", [decontam.BENCH_BYTES, 70])
def test_every_row_is_reported(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BENCH_BYTES", block)
    texts = sample_texts() + ["x one two three", "one two one two three two three"]
    assert decontam.contamination(documents(spark, texts), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == len(texts) + 1


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert decontam.contamination(docs, bench).count() == 0
    assert near_dup.component_table(docs).count() == 0
    assert quality.quality_verdicts(docs, labels).count() == 0
    assert packing.pack(docs).count() == 0
    assert lm_bloom.score_texts(docs).count() == 0
    root = Scratch(spark, "t").path("store")
    token_store.write_store(docs, root)
    assert token_store.read_checksums(spark, root).count() == 0
    some = documents(spark)
    assert decontam.contamination(some, bench).where("contaminated").count() == 0


def brute_components(texts):
    sets = []
    for t in texts:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def family(n, size, edits, seed):
    import random

    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates(spark):
    shared = " ".join(f"s{i}" for i in range(60))
    passage = [f"{shared} " + " ".join(f"u{i}_{j}" for j in range(12 + i % 3)) for i in range(60)]  # alike, but below the limit
    texts = sample_texts() + family(40, 150, 4, 1) + family(60, 90, 3, 2) + passage
    got = {r["doc_id"]: r for r in near_dup.component_table(documents(spark, texts, extra=True)).collect()}
    sizes, comps = brute_components(texts)
    assert [got[i * 3]["n_shingles"] for i in range(len(texts))] == sizes
    assert [got[i * 3]["component_id"] for i in range(len(texts))] == [c * 3 for c in comps]
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())


def test_near_duplicates_without_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, "x y z"), (7, "A b c d e f")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in near_dup.component_table(docs).collect())
    assert got == [(-1, -1, True), (-1, 5, False), (5, 5, True), (7, 5, False)]


@pytest.mark.parametrize("bits", [1, 1 << 25])
def test_one_of_each_is_kept_with_its_columns(spark, monkeypatch, bits):
    monkeypatch.setattr(near_dup, "MARK_BITS", bits)
    rows = [(i * 3, t) for i, t in enumerate(sample_texts())] + [(None, t) for t in sample_texts()[:9]] + [(9, sample_texts()[6]), (42, sample_texts()[14]), (None, "only a row without id"), (None, "only a row without id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bits", F.lit("clash")).withColumn("row", F.lit("clash")).withColumn("key", F.lit("clash")).withColumn("component", F.lit("clash")).repartition(3)
    sizes, comps = brute_components([t for _, t in rows])
    expected, best = [], {}
    for (doc_id, text), size, comp in zip(rows, sizes, comps):
        if not size:
            expected.append((doc_id, text))  # without words a row is linked with nothing
        elif comp not in best or (doc_id is None, doc_id or 0) < (best[comp][0] is None, best[comp][0] or 0):
            best[comp] = (doc_id, text)
    out = near_dup.keep_one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted([*expected, *best.values()], key=str)


def test_hot_buckets_and_shingles_lose_no_link(spark, monkeypatch):
    """With every key and shingle hot the components stay those of brute force."""
    monkeypatch.setattr(near_dup, "HOT_SHARE", 10**9)
    monkeypatch.setattr(near_dup, "KEY_SAMPLE", 1)
    monkeypatch.setattr(near_dup, "SPLIT", 3)
    monkeypatch.setattr(near_dup, "SMALL", 2)
    shared = " ".join(f"s{i}" for i in range(60))
    texts = family(40, 100, 5, 3) + family(30, 100, 5, 4) + [f"{shared} " + " ".join(f"u{i}_{j}" for j in range(12 + i % 3)) for i in range(30)]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.component_table(documents(spark, texts)).collect()}
    assert [got[i * 3] for i in range(len(texts))] == [c * 3 for c in brute_components(texts)[1]]


def test_recall_on_the_documents_table(spark):
    """Every row whose id is divisible by 50 against all rows: its links of similarity 0.85 or more must be inside its component."""
    path = "/root/testdata/sf0.01/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    docs = spark.read.parquet(path).select("doc_id", "text")
    rows = docs.collect()
    sets = {}
    for r in rows:
        w = words(r["text"])
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    links = [(a, b) for a in sets if a % 50 == 0 for b in sets if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.component_table(docs).collect()}
    assert links and all(got[a] == got[b] for a, b in links)


def test_pipeline_drops_pairs_from_eighty_percent(spark):
    import corpus_pipeline

    pairs = []
    for k in range(60):
        base = [f"v{k}_{i}" for i in range(200)]
        pairs += [" ".join(base), " ".join("new" if i % 40 == 20 and i < 160 else w for i, w in enumerate(base))]
    docs = documents(spark, pairs).distinct()
    shingles = [{tuple(words(t)[i : i + 5]) for i in range(196)} for t in pairs[:2]]
    assert 0.8 <= len(shingles[0] & shingles[1]) / len(shingles[0] | shingles[1]) < 0.85
    assert near_dup.component_table(docs).where("kept").count() == len(pairs)
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in left.collect()) == [6 * k for k in range(60)]


@pytest.mark.parametrize("small", [near_dup.SMALL, 2])
def test_near_duplicates_at_eighty_percent(spark, monkeypatch, small):
    monkeypatch.setattr(near_dup, "SMALL", small)
    texts = family(40, 150, 8, 5) + family(40, 100, 6, 6)
    sets = [{tuple(words(t)[i : i + 5]) for i in range(len(words(t)) - 4)} for t in texts]
    comps = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and comps[i] != comps[j]:
                lo, hi = sorted((comps[i], comps[j]))
                comps = [lo if c == hi else c for c in comps]
    got = {r["doc_id"]: r["component_id"] for r in near_dup.component_table(documents(spark, texts), near_dup.STAGE).collect()}
    assert [got[i * 3] for i in range(len(texts))] == [c * 3 for c in comps]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL", 2)
    texts = family(50, 100, 5, 3) + family(50, 100, 5, 4)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.component_table(documents(spark, texts)).collect()}
    assert [got[i * 3] for i in range(len(texts))] == [c * 3 for c in brute_components(texts)[1]]


def brute_counts(text):
    w = words(text, lower=False)
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = Counter(grams)
    repeated = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeated)


def test_quality_counts(spark):
    docs = documents(spark, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_verdicts(docs, labels).collect()}
    for i, t in enumerate(sample_texts()):
        r, e = got[i * 3], brute_counts(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 50 or 100 * e[4] > 50 * e[0])
        assert r["kept"] == (not r["base_failed"])  # labels too few to certify any cutoff


def test_certified_cutoffs_limit_false_rejection(spark):
    good = [" ".join(f"g{i}_{j}" for j in range(60)) for i in range(400)]  # two strata; a cutoff needs 183 good texts to be certified
    bad = [" ".join(f"b{i}_{j}###" for j in range(60)) for i in range(60)]
    docs = documents(spark, good + bad)
    labels = spark.createDataFrame([(i * 3, int(i < len(good)), 0) for i in range(len(good) + len(bad))], "doc_id long, quality int, toxic int")
    rows = quality.quality_verdicts(docs, labels).dropDuplicates(["doc_id"]).collect()
    lost = sum(not r["kept"] for r in rows if r["doc_id"] < 3 * len(good))
    caught = sum(not r["kept"] for r in rows if r["doc_id"] >= 3 * len(good))
    assert lost == 0 and caught == len(bad)
    kept = quality.keep_good(docs, labels)
    assert kept.schema == docs.schema and kept.dropDuplicates(["doc_id"]).count() == len(good)


def test_copies_are_one_trial_and_no_evidence(spark):
    copied = " ".join(f"c{j}" for j in range(60))
    texts = [copied] * 500 + [" ".join(f"b{i}_{j}###" for j in range(60)) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i < 500), 0) for i in range(len(texts))], "doc_id long, quality int, toxic int")
    assert quality.quality_verdicts(docs, labels).where("not kept").count() == 0


def test_rows_that_share_an_id_are_judged_by_their_own_text(spark):
    fine = " ".join(f"w{j}" for j in range(60))
    docs = spark.createDataFrame([(1, "word", "en"), (1, fine, "en"), (None, fine, None), (None, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted((r["doc_id"] or 0, r["n_words"], r["kept"]) for r in quality.quality_verdicts(docs, labels).collect()) == [(0, 0, False), (0, 60, True), (1, 1, False), (1, 60, True)]
    assert sorted((r["doc_id"] or 0, r["text"]) for r in quality.keep_good(docs, labels).collect()) == [(0, fine), (1, fine)]


def brute_cutoff(scores, good):
    """Best certified cutoff of one stratum among all, by the definition."""
    best, gain, n = None, 0, sum(good)
    for c in quality.GRID:
        lost, caught = sum(g and x > c for x, g in zip(scores, good)), sum(not g and x > c for x, g in zip(scores, good))
        if not n or sum(math.comb(n, i) * quality.ALPHA**i * (1 - quality.ALPHA) ** (n - i) for i in range(lost + 1)) > quality.DELTA:
            break
        if caught - quality.GOOD_WEIGHT * lost > gain:
            best, gain = c, caught - quality.GOOD_WEIGHT * lost
    return best


def test_cutoff_against_brute_force(spark):
    import random

    rng = random.Random(11)
    texts, good = [], []
    for i in range(500):
        good.append(rng.random() < 0.8)
        marks = rng.choice([0, 0, 0, 6, 12] if good[-1] else [0, 20, 40, 80, 120])
        texts.append(" ".join(f"t{i}_{j}{'#' if j < marks else ''}" for j in range(60)) + "#" * max(0, marks - 60))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good)], "doc_id long, quality int, toxic int")
    got = sorted((r["doc_id"], r["cutoff"], r["kept"]) for r in quality.quality_verdicts(docs, labels).collect())
    scores = [brute_counts(t)[2] / 60 / quality.SCALES["symbol_ratio"] for t in texts]
    cutoff = brute_cutoff(scores, good)
    assert cutoff is not None and got == [(i, cutoff, x <= cutoff) for i, x in enumerate(scores)]


def test_binomial_tail_is_exact():
    assert math.isclose(math.exp(quality.log_tail(2, 10, 0.3)), sum(math.comb(10, i) * 0.3**i * 0.7 ** (10 - i) for i in range(3)))
    assert quality.choose([0], [9], 5, 0.01, 0.05) is None  # five rows prove nothing


def test_packing_places_every_piece_once(spark):
    from tokenizers import Tokenizer

    texts = sample_texts()
    got = packing.pack(documents(spark, texts, extra=True), capacity=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(default_path())
    pieces, sequences = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        own = sorted(pieces[i * 3], key=lambda r: r["piece"])
        own = own[:: 2 if i == len(texts) - 1 else 1]  # the repeated row
        assert [x for r in own for x in r["ids"]] == ids and [r["start"] for r in own] == list(range(0, len(ids), 64))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(r["length"] for r in got)
    assert len(sequences) <= 1.03 * -(-total // 64) + 1


def test_sweep_handles_ties():
    rows = packing.sweep({10: 100, 3: 7, 1: 1}, 10)
    assert sum(r[2] for r in rows) == 108 and all(each * size <= 10 - offset for size, _, _, each, _, offset in rows)
    assert packing.sweep({}, 10) == []


def test_words_are_encoded_as_the_library_encodes_texts(monkeypatch):
    import pyarrow as pa

    from auditgrove.llm import tokens

    odd = ["Æsop naïve CAFÉ İstanbul ﬁne e\u0301 ß ŒUVRE x1y2 don't 'tis a.b c... (x) foo) éa, 汉字 ａｂ ﬀ ŉ ǅ ª º ² x².", "<|endoftext|>. a<|b", "ſ ſt K Å ς ΣΑΣ ", "a\u00a0b\u2003c d\u0085e", "x." * 50]
    own = tokens.Encoder(default_path())
    for cache in (tokens.CACHE_WORDS, 3):
        monkeypatch.setattr(tokens, "CACHE_WORDS", cache)
        for texts in ([t or "" for t in sample_texts()], odd, [""], []):
            ids, first = own.encode(pa.array(texts, pa.string()), 2)
            want = own.tokenizer.encode_batch(texts, add_special_tokens=False)
            assert [ids[lo:hi].tolist() for lo, hi in zip(first, first[1:])] == [w.ids + [2] for w in want]


def test_token_store_round_trip(spark):
    from tokenizers import Tokenizer

    texts, root = sample_texts(), Scratch(spark, "t").path("store")
    docs = documents(spark, texts, extra=True)
    token_store.write_store(docs, root)
    checks, whole = token_store.read_checksums(spark, root).collect(), token_store.read_documents(spark, root).collect()
    tokenizer, start = Tokenizer.from_file(default_path()), 0
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    ids.append(ids[-1])
    for own, c, d in zip(ids, sorted(checks, key=lambda r: r["start"]), sorted(whole, key=lambda r: r["start"])):
        assert (c["start"], c["n_tokens"], c["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        assert d["ids"] == own
        start += len(own)
    chunks = spark.read.parquet(f"{root}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_broken_chunk_is_found(spark):
    root = Scratch(spark, "t").path("store")
    token_store.write_store(documents(spark), root)
    bad = spark.read.parquet(f"{root}/chunks").withColumn("payload", F.concat(F.lit(b"\1\0"), F.expr("substring(payload, 3)")))
    rows = bad.collect()
    spark.createDataFrame(rows, bad.schema).write.mode("overwrite").parquet(f"{root}/chunks")
    with pytest.raises(Exception, match="does not match"):
        token_store.read_checksums(spark, root).collect()


def test_lost_or_doubled_recipes_are_found(spark):
    root = Scratch(spark, "t").path("store")
    token_store.write_store(documents(spark), root)
    recipes = spark.read.parquet(f"{root}/recipes")
    rows = recipes.collect()
    for broken in (rows[1:], rows + rows[:1]):
        spark.createDataFrame(broken, recipes.schema).write.mode("overwrite").parquet(f"{root}/recipes")
        with pytest.raises(Exception, match="do not match the manifest"):
            token_store.read_checksums(spark, root)


def test_merkle_root_is_that_of_the_tree_built_level_by_level():
    for n in range(20):
        tree, leaves = token_store.Merkle(), [bytes([i]) for i in range(n)]
        for leaf in leaves:
            tree.add(leaf)
        assert tree.root() == token_store.merkle_root(leaves)


def test_language_model_base_and_both_ways(spark):
    texts = [f"the cat sat on mat {i % 5} again" for i in range(60)] + sample_texts()
    docs = documents(spark, texts, extra=True)
    got, joined = ({(r["doc_id"], r["n_tokens"]): r for r in lm_bloom.score_texts(docs, limit).collect()} for limit in (1 << 30, 0))
    train, rows = Counter(), [(i * 3, t) for i, t in enumerate(texts)]
    rows.append(rows[-1])
    for d, t in rows:
        if zlib.crc32(str(d).encode()) % 7 != 2:
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    for d, t in rows:
        tokens = [*words(t), None]
        r = got[(d, len(tokens))]
        assert math.isclose(r["base_score"], sum(math.log10((train[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert (r["n_known"], r["train_tokens"], r["held_out"]) == (sum(train[w] > 0 for w in tokens), n, zlib.crc32(str(d).encode()) % 7 == 2)
        assert math.isclose(r["score"], joined[(d, len(tokens))]["score"], rel_tol=1e-9)
    score = brute_model([t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2])
    off = [abs(got[(d, len(words(t)) + 1)]["score"] - score(t)) for d, t in rows]
    assert sorted(off)[len(off) // 2] < 1e-6  # a false positive of the filter may lift a few tokens of the long texts
    assert max(x / (len(words(t)) + 1) for x, (_, t) in zip(off, rows)) < 0.02
    held = [r for r in got.values() if r["held_out"] and r["doc_id"] < 180]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_sends_no_batch_for_each_slice(spark, monkeypatch):
    """What tasks send may not grow with the product of texts and slices: one batch an order, however many slices there are."""
    sent = spark.sparkContext.accumulator(0)
    plain = type(spark.range(0)).mapInArrow

    def counting(self, run, *args, **more):
        def counted(batches):
            for batch in run(batches):
                sent.add(1)
                yield batch

        return plain(self, counted, *args, **more)

    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", counting)
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 37 + j * j) % 5000}" for j in range(400))) for i in range(40)], "doc_id long, text string").coalesce(1)
    got = {}
    for slice_bytes in (1 << 30, 512):
        monkeypatch.setattr(lm_bloom, "SLICE_BYTES", slice_bytes)
        for limit in (1 << 30, 0):
            before = sent.value
            got[slice_bytes, limit] = {r["doc_id"]: r["base_score"] for r in lm_bloom.score_texts(docs, limit).collect()}
            assert sent.value - before < 40
    assert all(g == got[1 << 30, 0] for g in got.values())


def test_language_model_counts_survive_their_packing():
    rng = np.random.default_rng(4)
    for slices in (1, 64, 1 << 16):
        for gram, width in ((1, 64), (2, 48)):
            hashes = np.unique(rng.integers(0, 1 << width, 3000, dtype=np.uint64, endpoint=False) if width < 64 else rng.integers(0, (1 << 64) - 1, 3000, dtype=np.uint64))
            counts = rng.choice([0, 1, 1, 1, 2, 300, 1 << 33], len(hashes))
            batch = lm_bloom.count_batch(hashes, counts, slices, gram, 7)
            assert batch.num_rows <= slices and set(batch.column("unit").to_pylist()) == {7}
            table, back = lm_bloom.pa.Table.from_batches([batch]), []
            for s in sorted(set(batch.column("slice").to_pylist())):
                own = table.filter(lm_bloom.pa.array(batch.column("slice").to_numpy() == s))
                back.append(lm_bloom.uncounted(lm_bloom.pa.concat_tables([own, own]), slices, gram)[:2])
            both = [np.concatenate([x[i][: len(x[i]) // 2] for x in back]) for i in (0, 1)]
            again = [np.concatenate([x[i][len(x[i]) // 2 :] for x in back]) for i in (0, 1)]
            assert all((a == b).all() and (a == c).all() for a, b, c in zip((hashes, counts), both, again))


def brute_model(train):
    """log10 probability of a text with exact counts, quantised like the filter's."""
    counts = {1: Counter(), 2: Counter(), 3: Counter()}
    for t in train:
        own = ["<s>", "<s>", *words(t), None]
        counts[1].update(own[2:])
        counts[2].update(zip(own[1:], own[2:]))
        counts[3].update(list(zip(own, own[1:], own[2:]))[1:])
    n, v = sum(counts[1].values()), len(counts[1])
    repeated = [sum(c for c in counts[k].values() if c >= lm_bloom.LEAST) for k in (2, 3)]
    weight2, weight3 = min(lm_bloom.MOST_WEIGHT, repeated[0] / n), min(lm_bloom.MOST_WEIGHT, repeated[1] / max(repeated[0], 1))
    least = lambda c: 2 ** math.floor(math.log2(c)) if c >= lm_bloom.LEAST else 0
    most = lambda c: 2 * least(c) - 1 if c >= lm_bloom.LEAST else 0

    def score(text):
        own, total, before = ["<s>", "<s>", *words(text), None], 0.0, 0.0
        for i in range(2, len(own)):
            c, history = counts[1][own[i]], len(train) if i == 2 else counts[1][own[i - 1]]
            pair, upper = (min(f(counts[2][own[i - 1], own[i]]), c, history) for f in (least, most))
            p = (1 - weight2) * (c + 1) / (n + v + 1) + weight2 * pair / max(history, 1)
            if i > 2 and before:
                p = (1 - weight3) * p + weight3 * min(least(counts[3][own[i - 2], own[i - 1], own[i]]), upper, before) / before
            total, before = total + math.log10(p), upper
        return total

    return score


def test_probabilities_of_a_history_sum_to_one_at_most():
    """50,000 words, most of them never seen behind the histories: false answers of the filter must not add up."""
    rng = np.random.default_rng(5)
    vocabulary = 50_000
    stream = rng.zipf(1.3, 400_000) % vocabulary
    hashes = lm_bloom.mix(np.arange(1, vocabulary + 1, dtype=np.uint64))
    unigrams = np.bincount(stream, minlength=vocabulary)
    pairs, pair_n = np.unique(stream[:-1] * vocabulary + stream[1:], return_counts=True)
    join = lambda a, b: lm_bloom.mix(hashes[a] * lm_bloom.STEP + hashes[b]) & lm_bloom.BITS_48
    own = join(pairs // vocabulary, pairs % vocabulary)[pair_n >= lm_bloom.LEAST]
    levels = lm_bloom.quantise(pair_n[pair_n >= lm_bloom.LEAST])
    bits = lm_bloom.build_bits(own, levels)
    held = lm_bloom.Filter(1, [(0, max(64, int(levels.sum()) * lm_bloom.BITS_PER_ENTRY), bits.tobytes())], len(bits))
    every = np.arange(vocabulary)
    for n in (2, 5, 20, 500):
        for v in np.flatnonzero(unigrams == unigrams[np.abs(unigrams - n).argmin()])[:3]:
            lower, upper = lm_bloom.count_bounds(held.levels(join(np.full(vocabulary, v), every)))
            true = np.bincount(stream[1:][stream[:-1] == v], minlength=vocabulary)
            assert np.minimum(lower, np.minimum(unigrams, unigrams[v])).sum() <= 1.05 * unigrams[v]
            assert ((lower <= true) & (true <= upper) | (true < lm_bloom.LEAST)).all()


def test_passages_seen_twice_score_higher(spark):
    import random

    rng = random.Random(2)
    vocabulary = [f"v{i}" for i in range(400)]
    texts = [" ".join(rng.choices(vocabulary, k=80)) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    per = {r["doc_id"]: r["score"] / r["n_tokens"] for r in lm_bloom.score_texts(docs).where("not held_out").collect()}
    both = [d for d in range(20) if d in per and d + 200 in per]
    assert both and min(per[d] for d in both) > max(x for d, x in per.items() if 20 <= d < 200)


def test_held_out_texts_without_structure_score_no_worse_than_words(spark):
    """Words drawn independently: no history helps, and it must cost little, also after frequent words whose bigrams are mostly seen once."""
    import random

    rng = random.Random(3)
    vocabulary = ["the"] * 400 + [f"v{i}" for i in range(4000)]
    docs = spark.createDataFrame([(i, " ".join(rng.choices(vocabulary, k=150))) for i in range(150)], "doc_id long, text string")
    held = lm_bloom.score_texts(docs).where("held_out").collect()
    tokens = sum(r["n_tokens"] for r in held)
    assert len(held) > 5 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) - 0.15 * tokens


def test_bloom_levels_only_err_upwards():
    hashes = lm_bloom.mix(np.arange(1, 5001, dtype=np.uint64)) & lm_bloom.BITS_48
    levels = np.repeat([1, 2, 3, 4, 5], 1000)
    bits = lm_bloom.build_bits(hashes, levels)
    table = lm_bloom.Filter(1, [(0, max(64, int(levels.sum()) * lm_bloom.BITS_PER_ENTRY), bits.tobytes())], len(bits))
    seen = table.levels(hashes)
    assert (seen >= levels).all() and (seen > levels).mean() < 0.01
    assert (table.levels(lm_bloom.mix(np.arange(10**6, 10**6 + 5000, dtype=np.uint64)) & lm_bloom.BITS_48) > 0).mean() < 0.005


def test_pipeline_end_to_end(spark, tmp_path):
    import corpus_pipeline

    clean = [" ".join(f"c{i}_{j}" for j in range(80)) for i in range(12)]
    leak = " ".join(f"q{j}" for j in range(12))
    other = " ".join(f"o{j}" for j in range(80))
    texts = clean + [clean[0], clean[1] + " tail", f"{clean[2]} {leak} after", "short", f"{other} {leak} after", None]
    documents(spark, texts).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # row 14 is a near copy of row 2 (76 of 89 shingles), rows 12 and 13 are copies, row 15 and the null text (twice) have too few words
    assert {r["doc_id"] for r in got} == {i * 3 for i in range(12)} | {16 * 3}
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(default_path())
    for i, text in [*enumerate(clean), (16, f"{other} after")]:
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        own = [r for r in got if r["doc_id"] == i * 3]
        assert [(r["piece"], r["length"], r["ids_crc32"], r["ids"]) for r in own] == [(0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)]
