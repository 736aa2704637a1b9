import random

import numpy as np
import pytest

from tallyrun.llm import paragraphs as pg

from .helpers import babble, docs, roots, words


def lowered(text):
    return [x.translate({c: c + 32 for c in range(65, 91)}) for x in words(text)]


def gram(three):
    """The hash of three words; its value is the operator's own, its use is checked here."""
    a, b, c = (int(x) for x in pg.Words([" ".join(three)]).hash)
    base = pg._BASES[1]
    return int(pg._mixed(np.array([(a + b * base + c * base * base) % (1 << 64)], np.uint64))[0])


def cut(w, reach):
    g = [gram(tuple(w[k : k + 3])) if k + 3 <= len(w) else float("inf") for k in range(len(w))]
    starts = [k for k in range(len(w)) if k == 0 or (all(g[k] < x for x in g[max(0, k - reach) : k]) and all(g[k] <= x for x in g[k + 1 : k + reach + 1]) and g[k] < float("inf"))]
    return list(zip(starts, starts[1:] + [len(w)]))


def places(text):
    """(start, end) of each word in code points."""
    out, at = [], 0
    for w in words(text):
        at = text.index(w, at)
        out.append((at, at + len(w)))
        at += len(w)
    return out


def brute(rows, similar=0.8, reach=pg.REACH, least_run=pg.LEAST_RUN):
    found = []
    for i, text in rows:
        w, at = lowered(text or ""), places(text or "")
        for k, (a, b) in enumerate(cut(w, reach)):
            found.append(((i is None, i or 0, k), i, k, at[a][0], at[b - 1][1], tuple(w[a:b])))
    alike = {}
    for f in found:
        alike.setdefault(f[5], f)
    distinct = list(alike)
    sets = [{d[k : k + 5] for k in range(max(1, len(d) - 4))} for d in distinct]
    holders = {}
    for n, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(n)
    pairs = {(a, b) for n in holders.values() for a in n for b in n if a < b}  # others have nothing in common
    root = dict(zip(distinct, roots(len(distinct), [(a, b) for a, b in pairs if len(sets[a] & sets[b]) >= similar * len(sets[a] | sets[b])])))
    first = {}
    for f in found:
        first[root[f[5]]] = min(first.get(root[f[5]], f[0]), f[0])
    out, repeats = [], {(f[0]): f for f in found if f[0] != first[root[f[5]]]}
    for f in repeats.values():
        n = len(f[5])
        for step in (-1, 1):
            k = f[2] + step
            while (f[0][0], f[0][1], k) in repeats:
                n += len(repeats[f[0][0], f[0][1], k][5])
                k += step
        if n >= least_run:
            kept = first[root[f[5]]]
            out.append((f[1], f[2], f[3], f[4], len(f[5]), None if kept[0] else kept[1], kept[2]))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    base = [babble(seed * 50 + k, r.randint(20, 90), 3000) for k in range(12)]
    rows = []
    for k in range(80):
        lines = [babble(seed * 999 + k * 10 + j, r.randint(5, 60), 3000) for j in range(3)]
        w = r.choice(base).split(" ")
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "changed"
        lines.insert(r.randint(0, 3), "  " + " ".join(w) + " ")
        rows.append((k * 7 % 83, "\n".join(lines)))
    rows += [(200, rows[4][1].upper()), (201, None), (202, ""), (None, rows[9][1]), (203, "word " * 20000), (204, "word " * 20000 + "x"), (205, base[0].replace(" ", "\t\v")), (206, "é" * 9000 + " ü " + base[1])]
    return rows


@pytest.mark.parametrize("seed,lot,least_run", [(1, 1000, 16), (2, 3, 1)])
def test_matches_brute_force(spark, seed, lot, least_run):
    rows = corpus(seed)
    table = docs(spark, rows).withColumnRenamed("lang", "p").withColumnRenamed("source", "para")
    got = sorted(map(tuple, pg.repeated_paragraphs(table, lot=lot, least_run=least_run, bands=20).collect()), key=str)
    assert got == brute(rows, least_run=least_run)


def test_empty_and_repeated_rows(spark):
    assert pg.repeated_paragraphs(docs(spark, [])).collect() == []
    a = babble(1, 30, 900)
    got = pg.repeated_paragraphs(docs(spark, [(1, a), (1, a), (2, a), (2, a), (3, None), (None, None)])).collect()
    assert {(r.doc_id, r.kept_doc_id) for r in got} == {(2, 1)} and len(got) == len(cut(lowered(a), pg.REACH))


def test_words_are_hashed_alike_everywhere():
    texts = ["", "One two", " \n", "x" * 5000 + " two one", "é two\v" * 70000, "ONE"]
    w = pg.Words(texts)
    assert [words(t) for t in texts] == [[t.encode()[a - s : b - s].decode() for a, b in zip(w.start[w.text == k], w.end[w.text == k])] for k, (t, s) in enumerate(zip(texts, w.text_start))]
    by = {}
    for k, (a, b) in enumerate(zip(w.start, w.end)):
        by.setdefault(w.data[a:b], set()).add(int(w.hash[k]))
    assert all(len(x) == 1 for x in by.values()) and len({y for x in by.values() for y in x}) == len(by) == 4
    assert int(pg.Words(["two"]).hash[0]) in by[b"two"]


def test_bands_meet_for_similar_sets():
    r = np.random.default_rng(1)
    met = 0
    first = np.array([0, 90])
    for _ in range(300):
        a = r.integers(0, 1 << 63, 90).astype(np.uint64)
        b = np.concatenate((a[:80], r.integers(0, 1 << 63, 10).astype(np.uint64)))  # 80 of 100
        keys = pg.band_keys(np.concatenate((a, b)), np.ones(180, bool), first)
        met += bool((keys[0] == keys[1]).any())
    assert met >= 297
    keys = pg.band_keys(r.integers(0, 1 << 63, 180).astype(np.uint64), np.ones(180, bool), first)
    assert not (keys[0] == keys[1]).any()


def test_similar_pairs_give_all_components():
    r = np.random.default_rng(4)
    sets = [np.unique(np.concatenate((np.arange(k // 6 * 100, k // 6 * 100 + 40), r.integers(10**6, 10**7, r.integers(0, 14))))).astype(np.uint64) for k in range(40)]
    want = roots(40, [(i, j) for i in range(40) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))])
    got = roots(40, list(pg.similar_pairs(sets, 0.8)))
    assert got == want


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, pg.op6_paragraph_dedup(spark, folder).collect()), key=str) == brute(rows)


def test_query_finds_planted_passages_and_leaves_clean_texts(spark, tmp_path):
    """Passages of 51 to 90 words inside other text, wrapped differently in every document: 0.9 of them at least."""
    r = random.Random(3)
    rows, holders = [], []
    for k in range(120):
        passage = babble(k + 5000, r.randint(51, 90), 4000).split(" ")
        for j in range(2):
            around = [babble(k * 10 + j * 3 + x, r.randint(20, 120), 4000).split(" ") for x in range(2)]
            text = around[0] + passage + around[1]
            width = r.randint(8, 200)
            rows.append((2 * k + j, "\n".join(" ".join(text[a : a + width]) for a in range(0, len(text), width))))
            holders += [2 * k + 1] * j
    notice = babble(77, 12, 900)
    rows += [(1000 + k, babble(k + 90000, 100, 4000) + "\n" + notice + "\n" + babble(k + 80000, 100, 4000)) for k in range(60)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    caught = {x.doc_id for x in pg.op6_paragraph_dedup(spark, str(tmp_path)).collect()}
    assert len(caught & set(holders)) >= 0.9 * len(holders)
    assert not caught - set(holders)
