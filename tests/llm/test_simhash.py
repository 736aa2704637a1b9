import random

import numpy as np
import pytest
import xxhash

from tallyrun.llm import simhash
from tallyrun.llm.components import components

from .helpers import babble, docs, roots, words


def naive_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [naive_fingerprint(t) for _, t in rows]
    root = roots(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if bin(fp[i] ^ fp[j]).count("1") <= 2])
    least = {}
    for (i, _), r in zip(rows, root):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sorted(((i, f"{f:016x}", least.get(r)) for (i, _), f, r in zip(rows, fp, root)), key=str)


def test_fingerprint_matches_the_definition():
    for t in ["", None, " \t\n", "One", "one TWO", "ÀB C d", "x " * 70000, babble(1, 500), "a b c\x1cd e"]:
        assert simhash.fingerprint(t or "") == naive_fingerprint(t)


@pytest.mark.parametrize("node_rows", [2000, 3])
def test_links_join_what_brute_force_joins(spark, node_rows):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {0, 1, 3, (1 << 64) - 1}
    for b in base:
        for _ in range(25):
            v = b
            for _ in range(r.randint(0, 4)):
                v ^= 1 << r.randrange(64)
            values.add(v)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), 2, node_rows)).collect()
    label = {x.node: x.label for x in got}
    root = roots(len(values), [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 2])
    ours = [label.get(v, v) for v in signed]
    assert all((root[i] == root[j]) == (ours[i] == ours[j]) for i in range(len(values)) for j in range(i))


def test_trie_pairs_are_exact():
    r = np.random.default_rng(3)
    v = np.unique(r.integers(0, 1 << 10, 300).astype(np.uint64) << np.uint64(40))
    got = sorted((int(i), int(j)) for a, b in simhash.trie_pairs(np.zeros(len(v), np.int64), v, 2) for i, j in zip(a, b))
    want = sorted((i, j) for j in range(len(v)) for i in range(j) if bin(int(v[i] ^ v[j])).count("1") <= 2)
    assert got == want


def test_documents_with_copies_nulls_and_ties(spark):
    text = babble(2, 300)
    rows = [(5, text), (3, text + " end"), (9, text.upper()), (1, None), (2, ""), (7, " \n"), (None, text), (8, babble(3, 50)), (8, babble(3, 50)), (4, "a"), (6, "word " * 30000)]
    got = simhash.near_duplicates(docs(spark, rows).withColumnRenamed("lang", "fp").withColumnRenamed("source", "key"))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]


def test_empty_table(spark):
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = simhash.op10_simhash_near_dedup(spark, folder).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_the_trie_splits_and_prunes_on_a_whole_table(spark):
    """The pairs of a whole table come by going down pairs of nodes, most of which the budget prunes."""
    fps = simhash.fingerprints(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    value = np.unique(np.array([r.fp for r in fps.select("fp").distinct().collect()], np.int64).view(np.uint64))
    counts = {}
    got = {(int(i), int(j)) for a, b in simhash.trie_pairs(np.zeros(len(value), np.int64), value, 2, counts) for i, j in zip(a, b)}
    near = np.bitwise_count(value[:, None] ^ value[None, :]) <= 2
    assert got == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))}
    assert counts["split"] > len(value) and counts["pruned"] > len(value)
