"""Rows that every corpus operator must bear."""

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, lower=True):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER) if lower else text or "")


def sample_texts(seed=7):
    rng = random.Random(seed)
    vocabulary = ["alpha", "beta", "Gamma", "été", "naïve", "x1", "über.", "the", "of", "don't", "###", "a|b"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    long = "\n".join(line(60) for _ in range(60))
    base = line(120)
    near = base.split()
    near[50] = "changed"
    return [None, "", "   \n\t ", "one", "one two three four", "one two three four five", base, base, " ".join(near), long, long + " end", line(40) + "\n" + base, "Same line here\n" * 30, line(80), line(200)]


def documents(spark, texts=None, extra=False):
    texts = sample_texts() if texts is None else texts
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[-1]) if rows else None  # a repeated row
    df = spark.createDataFrame(rows, DOCS)
    if extra:
        from pyspark.sql import functions as F

        for c in ("node", "kept", "a", "b", "key", "start", "length", "rank", "slice", "block", "stratum", "host"):
            df = df.withColumn(c, F.lit("clash"))
    return df
