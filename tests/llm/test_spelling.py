import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tallyrun.llm import spelling
from tests.llm.helpers import docs


def counted(rows, typo, least=6, times=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{w}".encode())
            if typo and h % typo == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += len(w) >= least
    return {w: n for w, n in counts.items() if n >= times}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(vocabulary, ratio=5):
    forms, out = {}, {}
    for w, n in vocabulary.items():
        others = sorted((-m, v) for v, m in vocabulary.items() if near(w, v))
        forms[w] = others[0][1] if others and -others[0][0] >= ratio * n else None
        out[w] = len(others)
    rows = []
    for w, n in vocabulary.items():
        root = w
        while forms[root]:
            root = forms[root]
        rows.append((w, forms[w], root, n, out[w], vocabulary[forms[w]] if forms[w] else None))
    return sorted(rows)


def corpus():
    """Stems with all kinds of variants, repeated letters, chains of forms and ties."""
    r = random.Random(5)
    stems = ["abcdefg", "aaaaaaa", "aaaaaa", "àéîõüß", "zebraline", "zebralines", "unitedly", "mississippi"]
    words = []
    for s in stems:
        for k in range(len(s)):
            words += [s[:k] + c + s[k + 1 :] for c in "abzÿ"] + [s[:k] + s[k + 1 :], s[:k] + r.choice("abz") + s[k:]]
    rows = []
    for k, w in enumerate(dict.fromkeys(words + stems)):
        rows.append((k, " ".join([w.upper() if k % 7 == 0 else w] * r.choice([1, 4, 5, 5, 24, 25, 26, 130, 700]))))
    return rows + [(None, "nameless " * 9), (3, None), (4, ""), (5, "-_0 ×÷"), (6, "x1y2 short"), (6, "x1y2 short")]


@pytest.mark.parametrize("typo", [None, 3, 199])
def test_matches_brute_force(spark, typo):
    rows = corpus()
    table = docs(spark, rows).withColumnsRenamed({"source": "word", "n_chars": "n"}).repartition(3)
    words = spelling.word_counts(table, typo=typo)
    vocabulary = counted(rows, typo)
    assert {r.word: r.n for r in words.collect()} == vocabulary and len(vocabulary) > 50
    got = sorted((tuple(r) for r in spelling.variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])
    assert got == brute(vocabulary)
    assert typo or any(r[1] and r[1] != r[2] for r in got), "no chain of forms"


def test_other_ratio_and_lengths(spark):
    words = {"abc": 5, "abcd": 10, "abcde": 20, "abcdf": 20, "xbc": 6}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), ratio=1.5, least_length=3)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute(words, 1.5)
    with pytest.raises(ValueError):
        spelling.variants(got, ratio=1)


def test_nothing_to_group(spark):
    for rows in ([], [(1, None), (2, ""), (3, "a few short words")]):
        assert spelling.variants(spelling.word_counts(docs(spark, rows))).collect() == []


def test_long_texts_are_cut_between_runs(spark, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", 11)
    text = "alphabet betagamma x gammadelta" + "long" * 40 + " alphabet"
    assert list(spelling._runs(text, spelling._LETTER)) == re.findall("[a-z]+", text)


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = spelling.op11_spelling_variants(spark, folder)
    sql = con.sql(spelling.ORACLES["op11_spelling_variants"])
    want = sql.fetchall()
    assert len(want) > 500
    assert sorted(map(repr, map(tuple, got.select(*sql.columns).collect()))) == sorted(map(repr, want))
