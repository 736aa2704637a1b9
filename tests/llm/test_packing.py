import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyrun.llm import packing

from .helpers import babble, docs

LIBRARY = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))


def least_bins(sizes, room):
    """A lower bound: by volume, and for each k by the items that leave no room for one of k and those over half."""
    best = -(-sum(sizes) // room)
    for k in {x for x in sizes if x <= room // 2} | {0}:
        alone = sum(x > room - k for x in sizes)
        halves = [x for x in sizes if room // 2 < x <= room - k]
        over = sum(x for x in sizes if k <= x <= room // 2) - (len(halves) * room - sum(halves))
        best = max(best, alone + len(halves) + max(0, -(-over // room)))
    return best


def check(rows, got, length=1024):
    """Every piece is there once, cut as asked, and every sequence is gapless and within its length."""
    want = []
    for i, text in rows:
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % length or min(length, len(ids))
        cuts = [0, *range(first, len(ids) + 1, length)]
        want += [(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((tuple(g)[:5] for g in got), key=str) == sorted(want, key=str)
    places = {}
    for g in got:
        places.setdefault(g.sequence_id, []).append((g.offset, g.length))
    for p in places.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
        assert at <= length
    return len(places), least_bins([w[3] for w in want], length)


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_items_and_helps(seed):
    r = random.Random(seed)
    sizes = [r.randint(1, [100, 60, 45, 70, 100, 100][seed]) if seed < 5 else r.choice([40, 50, 27, 33]) for _ in range(700)]
    start = packing.Bins(sizes, 100)
    start.best_fit()
    before = len(start.items), sum(f * f for f in start.fill)
    start.search()
    assert sorted(i for b in start.items for i in b) == list(range(700))
    assert all(sum(sizes[i] for i in b) == f <= 100 for b, f in zip(start.items, start.fill))
    assert len(start.items) <= before[0] and sum(f * f for f in start.fill) >= before[1]


def test_a_swap_empties_a_bin():
    bins = packing.Bins([6, 3, 5, 4, 1, 1], 10)
    bins.items, bins.fill, bins.bin = [[0, 1], [2, 3], [4, 5]], [9, 9, 2], [0, 0, 1, 1, 2, 2]
    bins.search()
    assert sorted(bins.fill) == [10, 10]
    bins = packing.Bins([5, 4, 5, 3, 3], 10)  # two for one: 4 goes, 5 comes
    bins.items, bins.fill, bins.bin = [[0, 1], [2, 3], [4]], [9, 8, 3], [0, 0, 1, 1, 2]
    bins.search()
    assert sorted(bins.fill) == [10, 10]


def test_nulls_long_texts_repeats(spark):
    rows = [(k, babble(k, 40 * (k % 30) + 1)) for k in range(120)] + [(200, None), (201, ""), (None, "x"), (5, babble(5, 201)), (5, babble(5, 201)), (202, "word " * 20000), (203, "a<|endoftext|>b")]
    table = docs(spark, rows).withColumnRenamed("lang", "length").withColumnRenamed("source", "offset")
    got = packing.packed(table).collect()
    used, least = check(rows, got)
    assert used <= least + 2
    small = packing.packed(table, group=50).collect()
    assert len({g.sequence_id for g in small}) <= least + 2 * 6
    check(rows, small)
    assert packing.packed(docs(spark, [])).collect() == []


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    used, least = check(rows, packing.op8_swap_packing(spark, folder).collect())
    assert used <= 1.01 * least + 1
