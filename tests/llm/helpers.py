"""Small fixtures and brute-force helpers shared by the operator tests."""

import random

from pyspark.sql import types as T

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
BLANKS = " \t\n\v\f\r"


def docs(spark, rows):
    """A documents table from (doc_id, text) or whole rows."""
    full = [(*r, *("en", "s0", len(r[1] or ""))[: 5 - len(r)]) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, DOC)


def words(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch in BLANKS:
            if word:
                out.append(word)
            word = ""
        else:
            word += ch
    return out


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def babble(seed, n, vocabulary=40):
    r = random.Random(seed)
    names = ["".join(r.choice("abdeiklmnorstuéß") for _ in range(r.randint(1, 7))) for _ in range(vocabulary)]
    return " ".join(r.choice(names) for _ in range(n))
