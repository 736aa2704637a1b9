import random

import corpus_pipeline as cp
from tallyrun.llm import near_copies as nc

from .helpers import babble, docs, roots, words


def brute(rows, similar=0.8):
    """The least id of each document's group by five-word Jaccard similarity; rows by unique ids."""
    w = [tuple(x.translate({c: c + 32 for c in range(65, 91)}) for x in words(t)) for _, t in rows]
    sets = [{x[k : k + 5] for k in range(max(1, len(x) - 4))} for x in w]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if w[i] == w[j] or len(sets[i] & sets[j]) >= similar * len(sets[i] | sets[j])])
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min(least.get(r, i), i)
    return {i: least[r] for (i, _), r in zip(rows, root)}


def corpus(seed):
    r = random.Random(seed)
    base = [babble(seed * 70 + k, r.randint(60, 300), 3000) for k in range(15)]
    rows = []
    for k in range(90):
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, max(2, len(w) // 40))):
            w[r.randrange(len(w))] = "changed"
        rows.append((k * 7 % 97, " ".join(w)))
    return rows + [(200, rows[4][1].upper()), (201, None), (202, " \n"), (203, "one two"), (204, "One\ttwo"), (205, "one two three"), (206, "word " * 20000), (207, "word " * 20000 + "x")]


def test_stage_matches_brute_force_jaccard(spark):
    rows = corpus(3)
    want = brute(rows)
    got = sorted(r.doc_id for r in cp.near_dedup(spark, docs(spark, rows), "").collect())
    assert got == sorted(i for i, least in want.items() if i == least)


def test_lots_give_the_same_components(spark):
    rows = corpus(5)
    groups = {}
    for r in nc.near_copies(docs(spark, rows), lot=3).collect():
        groups.setdefault(r.component, []).append(r.doc_id)
    assert {i: min(g) for g in groups.values() for i in g} == brute(rows)


def test_stage_on_a_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute([tuple(r) for r in table.select("doc_id", "text").collect()])
    got = sorted(r.doc_id for r in cp.near_dedup(spark, table, "").collect())
    assert got == sorted(i for i, least in want.items() if i == least)


def test_empty_table(spark):
    assert nc.near_copies(docs(spark, [])).collect() == []


def test_stage_keeps_one_row_of_each_group_with_null_and_repeated_ids(spark):
    a, b, c, d = (babble(k, 80, 3000) for k in range(4))
    rows = [(1, a), (1, a), (2, a + " end"), (None, b), (None, b), (None, b + " end"), (3, c), (3, d), (2, d), (None, c)]
    kept = cp.near_dedup(spark, docs(spark, rows), "").collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(1, a), (2, d), (3, c)]
    assert [r.text.startswith(b) for r in kept if r.doc_id is None] == [True]
