"""Fixtures for the training-data operators: awkward documents and brute-force versions."""

import random
import re

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
SPACE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def words(s, pattern=SPACE):
    return re.findall(pattern, s or "")


def make(spark, rows, schema=DOCS, parts=3):
    rows = [tuple(r) + (None,) * (len(schema) - len(r)) for r in rows]
    return spark.createDataFrame(rows, schema).repartition(parts) if rows else spark.createDataFrame([], schema)


def corpus(seed=1, n=60):
    """Texts with shared passages, copies, near copies, repeated lines and odd characters."""
    rng = random.Random(seed)
    vocab = [f"{a}{b}" for a in ("ka", "to", "ré", "mi", "Su", "lö", "an", "de") for b in ("ra", "ß", "ne", "x", "um", "ti", "ó", "Q")]
    text = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = text(40), "A common line, of all."
    docs = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            t = text(rng.randint(1, 80))
        elif kind == 1:
            t = text(10) + "\n" + passage + " \t" + text(5)
        elif kind == 2:
            t = "  " + line.upper() + "\r\n" + text(30) + "\n\n" + line
        elif kind == 3 and docs:
            t = docs[rng.randrange(len(docs))][1]
        elif kind == 4 and docs:
            w = (docs[rng.randrange(len(docs))][1] or "x").split(" ")
            w[rng.randrange(len(w))] = "Edited"
            t = " ".join(w)
        else:
            t = "\u00a0odd\u2003 " + text(20) + " 日本語 \x0b end"
        docs.append((i * 7 % n, t, "en", f"s{i % 4}"))
    return docs


#: null and empty texts, only blanks, repeated rows, one id with two texts, null id, one very long text
AWKWARD = [(1000, None), (1001, ""), (1002, " \n\t \n"), (1003, "one"), (1003, "one"), (1004, "twice this text"), (1004, "twice that text"),
           (None, "text without an id but with many words so that it has windows of all the sizes that are in use"),
           (None, None), (1005, "long " * 30_000), (1006, "x" * 100_000)]
