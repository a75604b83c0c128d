"""Collocations, filter interactions and repeated passages against brute force, with nulls, empty, long, tied and repeated rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditgrove.llm import collocations, filter_audit, queries, substring_dedup

from .common import DOCS, LOWER, documents, sample_texts, words

LABELS = "doc_id long, quality int, toxic int"
SF = "/root/testdata/sf0.001"


def same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    got, found = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    at = [found.columns.index(c) for c in got.columns]
    assert sorted(found.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_collocations", "op12_filter_audit", "op13_substring_dedup"])
def test_whole_tables_against_sql(spark, name):
    same_as_sql(spark, name)


# ---- collocations --------------------------------------------------------------------------------------------------


def brute_phrases(rows, least, longest, top):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(own)
            for k in range(1, longest + 1):
                f[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = set()
    for lang, counts in f.items():
        found = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            inside = lambda q: len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))  # noqa: E731, B023
            if not any(inside(q) and 100 * c >= 80 * a for q, c in found.items()):
                s, _, l, r = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                rows.append((-s, -a, " ".join(p).encode(), l, r))
        out |= {(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])}
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "New", "york", "été", "x,y", "naïve", "a.b", "z"] + [f"w{i}" for i in range(12)]
    line = lambda n: " ".join(rng.choices(vocabulary, [30, 20, 9, 9, 5, 2, 3, 2, 4] + [1] * 12, k=n))
    texts = [line(rng.randrange(1, 60)) + rng.choice([". ", "\n", "\t", "; "]) + "New York city hall" * rng.randrange(3) for _ in range(120)]
    texts += [None, "", " \t ", ".,;", "one", "the " * 3000, line(4000)] + texts[:9]
    return [(rng.choice(["en", "de", None, "und", ""]), t) for t in texts]


@pytest.mark.parametrize("head,tile,block,dense", [(1 << 18, 256, 6 << 20, 8), (1 << 18, 4, 6 << 20, 8), (5, 4, 900, 4), (0, 256, 300, 8)])
def test_collocations(spark, monkeypatch, head, tile, block, dense):
    for name, value in (("HEAD", head), ("TILE", tile), ("BLOCK", block), ("DENSE", dense)):
        monkeypatch.setattr(collocations, name, value)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("n", F.lit("clash")).withColumn("phrase", F.lit("clash")).repartition(3)
    for least, longest, top in ((3, 4, 2000), (6, 3, 5)):
        got = [tuple(r) for r in collocations.mine(docs, least, longest, top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
        assert len(got) == len(set(got)) and set(got) == brute_phrases(rows, least, longest, top)


def test_collocations_of_nothing(spark):
    assert collocations.mine(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("en", "a b c")], "lang string, text string")).count() == 0


def test_tiles_count_like_a_counter():
    rng = np.random.default_rng(1)
    left, right = rng.zipf(1.2, 200_000) % 3000, rng.zipf(1.2, 200_000) % 2000
    ranks = [np.where(rng.random(n) < 0.9, rng.permutation(n), -1) for n in (3000, 2000)]
    got = collocations.tiled_counts(left, right, *ranks)
    assert {(a, b): c for a, b, c in zip(*(x.tolist() for x in got))} == dict(Counter(zip(left.tolist(), right.tolist()))) and len(got[0]) == len({*zip(left.tolist(), right.tolist())})


# ---- filter audit --------------------------------------------------------------------------------------------------


def brute_audit(rows, labels):
    """rows: (doc_id, text, source)."""
    least, marks = {}, defaultdict(lambda: [0, 0])
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            marks[i] = [marks[i][0] or int(q == 1), marks[i][1] or int(x == 1)]
    parts = defaultdict(list)
    for i, t, s in rows:
        text, w = t or "", words(t, lower=False)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and i > least[text]}
        parts[s or ""].append(({f for f, x in fails.items() if x}, *(marks[i] if i is not None else (0, 0))))
    out = set()
    for part, docs in parts.items():
        removed = Counter()
        steps = []
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                now = [d for d in docs if f in d[0] and not d[0] & set(order[:k])]
                removed[f] += len(now)
                kept = sum(not d[0] & set(order[: k + 1]) for d in docs)
                late = sum(f in d[0] and bool(d[0] & set(order[:k])) for d in docs)
                steps.append(("".join(order), k + 1, f, kept, len(now), late, sum(d[0] == {f} for d in docs), sum(d[1] for d in now), sum(d[2] for d in now)))
        out |= {(part, o, k, *numbers, removed[f]) for o, k, f, *numbers in steps}
    return out


def test_filter_audit(spark):
    rng = random.Random(8)
    texts = sample_texts() + ["UPPER lower " * 40, " ".join(f"w{i}" for i in range(60)), "x" * 50_000 + " y" * 60_000, None, ""]
    rows = [(i * 3, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(200 + i, rng.choice(texts), rng.choice(["s0", None, ""])) for i in range(60)]
    rows += [rows[8], rows[8], (None, texts[8], "s1"), (None, "only without id", None), (0, "another text of id 0", "s2")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 60, 3)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("bits", F.lit(7)).repartition(5)
    marks = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit("clash"))
    got = [tuple(r) for r in filter_audit.interactions(docs, marks).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()]
    assert len(got) == 600 * 4 and set(got) == brute_audit(rows, labels)
    assert filter_audit.interactions(spark.createDataFrame([], DOCS), marks).count() == 0
    assert filter_audit.interactions(documents(spark), spark.createDataFrame([], LABELS)).agg(F.sum("good_lost")).first()[0] == 0


def test_merges_of_lists():
    rng = np.random.default_rng(0)
    for size in (0, 1, 50, 400):
        lists = [np.unique(rng.integers(0, 500, rng.integers(0, size + 1))).astype(np.int32) for _ in range(7)]
        sets, got = [set(x.tolist()) for x in lists], filter_audit.sizes_of(lists)
        for f in range(5):
            for s in range(32):
                if not s >> f & 1:
                    before = set().union(*[sets[g] for g in range(5) if s >> g & 1])
                    left = sets[f] - before
                    assert got[f, s].tolist() == [len(left), len(before | sets[f]), len(left & sets[5]), len(left & sets[6])]


# ---- repeated passages ---------------------------------------------------------------------------------------------


def brute_repeats(rows, window):
    first = {}
    late_id = 1 << 63
    own = [((late_id if i is None else i), words(t, lower=False)) for i, t in rows]
    for i, w in own:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(i, first.get(g, i))
    out = []
    for (doc_id, _), (i, w) in zip(rows, own):
        gone = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((-1 if doc_id is None else doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def repeated_rows(seed=6):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["été", "The", "the"]
    line = lambda n: rng.choices(vocabulary, k=n)
    passage, long = line(60), line(300)
    texts = sample_texts() + [" ".join(line(20) + passage + line(15)), " ".join(passage), " \n".join(passage[5:40] + line(8)), " ".join(line(3) + long), " ".join(long[:200] + ["cut"] + long[200:]), "spam " * 500, "spam " * 13, "spam " * 12, "a b " * 90]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(100 - i, rng.choice(texts)) for i in range(30)]
    return rows + [rows[18], rows[18], (None, texts[18]), (None, " ".join(line(5) + passage)), (None, None), (9, " ".join(line(30))), (9, " ".join(passage[10:30]))]


@pytest.mark.parametrize("window,block,bits", [(13, 12 << 20, 20), (13, 400, 5), (5, 3000, 20), (30, 3000, 8)])
def test_repeated_passages(spark, monkeypatch, window, block, bits):
    """Small bitmaps report a great part of what they do not hold; results stay the same."""
    monkeypatch.setattr(substring_dedup, "BLOCK", block)
    monkeypatch.setattr(substring_dedup, "LEAST_BITS", bits)
    monkeypatch.setattr(substring_dedup, "MOST_BITS", max(bits, 8))
    monkeypatch.setattr(substring_dedup, "MOST_TEXT_BITS", max(bits, 6))
    rows = repeated_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("n", F.lit("clash")).repartition(4)
    got = substring_dedup.remove_repeats(docs, window)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()) == brute_repeats(rows, window)


def test_nothing_repeats(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0
    texts = [" ".join(f"d{i}w{j}" for j in range(40)) for i in range(5)] + [None, "", "short"]
    got = substring_dedup.remove_repeats(documents(spark, texts)).collect()
    assert len(got) == len(texts) + 1 and all(r["n_removed"] == 0 for r in got)
    assert substring_dedup.levels(13) == [7, 13] and substring_dedup.levels(50) == [7, 13, 25, 50] and substring_dedup.levels(8) == [8]
