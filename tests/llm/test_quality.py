import duckdb
import numpy as np
import pytest

from tallyrun.llm import quality

from .helpers import babble, docs, words


def naive(text, m=quality.MIN_REPEAT):
    w = words(text)
    n = len(w)
    best = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and w[i + k] == w[j + k]:
                k += 1
            best[i], best[j] = max(best[i], k), max(best[j], k)
    union = lambda least: len({p for i in range(n) if best[i] >= least for p in range(i, i + best[i])})
    text = text or ""
    lines = [x for x in text.split("\n") if words(x)]
    failed = n < 50 or 100 * union(3) > 50 * n
    kept = not failed and union(m) <= quality.MAX_COVERED * n and max(best, default=0) <= quality.MAX_LONGEST
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), union(3), failed, kept, union(m), max(best, default=0))


TEXTS = [
    None, "", " \n\t", "one", "é " * 60, babble(1, 200), babble(2, 120, 5), babble(3, 300, 400), babble(4, 40), "a b c " * 3 + babble(5, 80, 900),
    (p := babble(6, 40, 999)) + " x " + p + " " + babble(7, 300, 999), "l1 # *\nl2\nl1 # *\n\nl2 \n" + babble(8, 100, 900), "\x1cq\x85 z" * 30 + babble(9, 90, 999),
]


def test_statistics_and_verdicts(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[5]), (3, "one")]
    table = docs(spark, rows).withColumnRenamed("source", "kept").withColumnRenamed("lang", "n_words")
    got = sorted(map(tuple, quality.quality(table).collect()), key=str)
    assert got == sorted(((i, *naive(t)) for i, t in rows), key=str)


def test_long_text_and_long_repeat(spark):
    p = babble(11, 160, 10**6)
    long = babble(12, 20000, 10**6)
    got = {r.doc_id: r for r in quality.quality(docs(spark, [(1, p + " z " + p + " " + long), (2, long), (3, "w " * 20000)])).collect()}
    assert got[1].longest_repeat == 160 and not got[1].kept and not got[1].base_failed
    assert got[2].kept and got[3].longest_repeat == 19999 and got[3].base_failed


@pytest.mark.parametrize("seed", range(4))
def test_longest_repeats_of_many_texts_at_once(seed):
    r = np.random.default_rng(seed)
    text = np.sort(r.integers(0, 6, 120))
    symbols = r.integers(0, 2 + seed, 120)
    want = []
    for i in range(120):
        best = 0
        for j in range(120):
            if i != j and text[i] == text[j]:
                k = 0
                while max(i, j) + k < 120 and text[i + k] == text[i] == text[j + k] and symbols[i + k] == symbols[j + k]:
                    k += 1
                best = max(best, k)
        want.append(best)
    assert quality.longest_repeats(symbols, text).tolist() == want


def test_empty_table(spark):
    assert quality.quality(docs(spark, [])).collect() == []


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = quality.op7_quality_repetition(spark, folder)
    sql = con.sql(quality.ORACLES["op7_quality_repetition"])
    assert sorted(sql.columns) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_prefixes_along_the_text_are_the_same(seed, monkeypatch):
    r = np.random.default_rng(seed)
    text = np.sort(r.integers(0, 4, 400))
    symbols = r.integers(0, 3, 400)
    symbols[100:200] = 1
    want = quality.longest_repeats(symbols, text).tolist()
    monkeypatch.setattr(quality, "LEVELS", 1)
    assert len(quality.suffix_ranks(symbols, text)) == 1 and quality.longest_repeats(symbols, text).tolist() == want


def test_a_long_repetitive_text_keeps_few_levels(monkeypatch):
    monkeypatch.setattr(quality, "LEVELS", 8 << 20)
    n = 1 << 18
    assert quality.repetition(["a b " * (n // 2)])[:, 0].tolist() == [n, n, n, n - 2]
