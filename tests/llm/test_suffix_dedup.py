import hashlib
import random

import numpy as np
import pytest

from tallyrun.llm import suffix_dedup as sd

from .helpers import babble, docs


def brute(rows, length=100):
    first = {}
    data = [(i, (t or "").encode()) for i, t in rows]
    key = lambda i: (i is None, i or 0)
    for i, d in data:
        for s in range(len(d) - length + 1):
            w = d[s : s + length]
            if w not in first or (key(i), s) < first[w]:
                first[w] = (key(i), s)
    out = []
    for i, d in data:
        gone = bytearray(len(d))
        for s in range(len(d) - length + 1):
            if first[d[s : s + length]] < (key(i), s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def digest(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def corpus(seed):
    r = random.Random(seed)
    passages = [babble(1000 + k, 40, 5000) for k in range(4)]
    rows = []
    for k in range(60):
        text = babble(seed * 100 + k, r.randint(1, 120), 5000)
        if k % 3 == 0:
            cut = r.randint(0, len(text))
            p = r.choice(passages)
            text = text[:cut] + p[r.randint(0, 40) :] + text[cut:]
        rows.append((k * 13 % 61, text))
    for k in range(8):  # near copies
        t = list(rows[k][1])
        for _ in range(3):
            if t:
                t[r.randrange(len(t))] = "#"
        rows.append((100 + k, "".join(t)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (202, "a" * 500), (203, "ab" * 300), (204, "é" * 200), (205, None), (206, ""), (None, rows[7][1]), (207, rows[9][1] * 3)]
    return rows


@pytest.mark.parametrize("crowd", [2000, 3, 1])
def test_matches_brute_force(spark, crowd):
    rows = corpus(3)
    table = docs(spark, rows).withColumnRenamed("lang", "kept").withColumnRenamed("n_chars", "tag")
    got = sd.remove_repeats(table.repartition(5), crowd=crowd)
    assert digest(got) == brute(rows)


def test_repeated_ids_and_kept_bytes(spark):
    p = babble(1, 60, 5000)
    rows = [(1, p), (1, p), (1, "xyz " + p), (2, "é" + p + "ü")]
    got = sd.remove_repeats(docs(spark, rows), carry=("source",))
    assert digest(got) == brute(rows)
    by = {r.n_bytes: r for r in got.collect()}
    last = by[len(p.encode()) + 4]
    assert bytes(last.kept) in ("éü".encode(), b"xyz ") and last.source == "s0"
    assert sd.remove_repeats(docs(spark, [])).collect() == []
    assert digest(sd.remove_repeats(docs(spark, [(1, None), (2, "x")]))) == brute([(1, None), (2, "x")])


def test_crowded_anchors_are_dealt_again_and_merged(spark, monkeypatch):
    """Many different texts around one passage: longer grams split them, and what still differs goes through the merge."""
    passage = babble(9, 30, 5000)[:140]
    rows = [(k, babble(500 + k, 20, 5000) + passage + babble(700 + k % 6, 20, 5000)) for k in range(30)]
    grams, find = [], sd._find_segments
    monkeypatch.setattr(sd, "_find_segments", lambda b, n, g, p: grams.append(g) or find(b, n, g, p))
    got = digest(sd.remove_repeats(docs(spark, rows).repartition(4), crowd=8))
    assert got == brute(rows) and sum(r[2] for r in got) >= 29 * 140
    assert grams[:2] == [40, 70] and len(grams) <= 4
    assert sd.longer_grams(100, 40) == [70, 85, 100]


def test_long_text(spark):
    rows = [(1, babble(5, 20000, 300)), (2, babble(6, 300, 300)), (3, "Orre " * 5000)]
    assert digest(sd.remove_repeats(docs(spark, rows))) == brute(rows)


@pytest.mark.parametrize("length", [40, 200, 400, 600])
def test_other_lengths(spark, length):
    """Segments of long windows have more of these than a byte counts."""
    passage, r = babble(9, 400, 5000), random.Random(length)
    rows = [(k, babble(50 + k, r.randint(20, 90), 5000) + passage[r.randint(0, 300) : r.randint(900, 1700)] + babble(90 + k, 30, 5000)) for k in range(25)]
    rows += [(30, "ab" * 900), (31, rows[3][1]), (32, "x" * length), (33, "x" * length), (34, "x" * (length - 1))]
    got = digest(sd.remove_repeats(docs(spark, rows).repartition(4), length=length))
    assert got == brute(rows, length) and sum(r[2] for r in got) > 5000


def test_texts_over_several_units(spark):
    """Texts of more than a unit, one with the repeat of a passage that lies over the seam of two."""
    long = babble(1, 420_000, 60_000)
    assert len(long.encode()) > sd.UNIT + 200_000
    seam = len(long.encode()[: sd.UNIT].decode(errors="ignore"))
    rows = [(2, long), (5, "before " + long[seam - 700 : seam + 700] + " after"), (1, babble(3, 80, 5000) + long[seam - 150 : seam + 20]), (9, long[-400:] + long[:400])]
    got = digest(sd.remove_repeats(docs(spark, rows)))
    assert got == brute(rows) and got[-1][2] >= 796


@pytest.mark.parametrize("seed", range(3))
def test_merged_transforms_equal_sorted_suffixes(seed):
    r = np.random.default_rng(seed)
    shards, words = [], []
    for _ in range(3):
        strings = [r.integers(1, 4, r.integers(1, 9)) for _ in range(6)]
        words.append(strings)
        shards.append(sd.Shard(np.concatenate(strings), np.cumsum([len(s) for s in strings])))
    shard, row, block = sd.merge(shards, 3)
    suffixes = []
    for k, s in zip(shard, row):
        at = shards[k].place[row[len(suffixes)]]
        if at < 0:
            suffixes.append((0,))
            continue
        whole, ends = np.concatenate(words[k]), np.cumsum([len(x) for x in words[k]])
        suffixes.append(tuple(whole[at : ends[np.searchsorted(ends, at, side="right")]].tolist()))
    cut = [s[:3] for s in suffixes]
    assert sorted(cut) == cut
    for k in range(1, len(cut)):
        assert (block[k] == block[k - 1]) == (cut[k] == cut[k - 1] and len(cut[k]) == 3)


def test_windows_of_pieces():
    a, b = babble(1, 50, 5000).encode(), babble(2, 50, 5000).encode()
    pieces = [a[:150], b"x" + a[:120], b, a[20:140]]
    doc, start = np.array([5, 4, 3, 6]), np.array([10, 0, 0, 7])
    got = sorted(zip(*(x.tolist() for x in sd.repeated_windows(pieces, doc, start, shard_bytes=200))))
    want, first = [], {}
    for p, piece in enumerate(pieces):
        for o in range(len(piece) - 99):
            w, at = piece[o : o + 100], (doc[p], start[p] + o)
            first[w] = min(first.get(w, at), at)
    for p, piece in enumerate(pieces):
        want += [(p, o) for o in range(len(piece) - 99) if first[piece[o : o + 100]] < (doc[p], start[p] + o)]
    assert got == sorted(want)


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert digest(sd.op4_suffix_dedup(spark, folder)) == brute(rows)
