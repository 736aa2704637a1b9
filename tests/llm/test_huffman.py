import heapq
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallyrun.llm import huffman

from .helpers import babble, docs

LIBRARY = Tokenizer.from_file(public_tokenizers.path(huffman.TOKENIZER))


def brute(rows):
    at, out = 0, []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def huffman_cost(counts):
    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def limited_cost(counts, most):
    """Least cost of a prefix code with a length limit, by trying all lengths that Kraft's sum allows."""
    c = sorted((int(x) for x in counts if x), reverse=True)
    best = {1 << most: 0}
    for x in c:  # lengths do not fall as counts do not rise; states: what is left of Kraft's sum
        nxt = {}
        for left, cost in best.items():
            for n in range(1, most + 1):
                rest = left - (1 << (most - n))
                if rest >= 0 and nxt.get(rest, 1 << 60) > cost + x * n:
                    nxt[rest] = cost + x * n
        best = nxt
    return min(best.values())


@pytest.mark.parametrize("seed", range(5))
def test_lengths_are_optimal_and_limited(seed):
    r = np.random.default_rng(seed)
    counts = (r.pareto(0.5, 300) * 10).astype(np.int64) % 10**9
    lengths = huffman.code_lengths(counts).astype(int)
    assert (lengths[counts == 0] == 0).all() and lengths.max() <= huffman.MOST_BITS
    assert sum(2.0 ** -n for n in lengths[lengths > 0]) <= 1
    if lengths.max() < huffman.MOST_BITS:
        assert int((counts * lengths).sum()) == huffman_cost(counts)
    few = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 0])
    for most in (4, 5, 6):
        assert int((few * huffman.code_lengths(few, most)).sum()) == limited_cost(few, most)


def test_files_round_trip_in_whole_and_by_blocks():
    r = np.random.default_rng(1)
    ids = np.minimum((r.pareto(0.7, 5000) * 3), 50000).astype(np.uint32)
    lengths = huffman.code_lengths(np.bincount(ids)).tobytes()
    sizes = np.array([0, 1, 2999, 2000, 0])
    data = huffman.encode_file(np.arange(5), sizes, ids, lengths, 64)
    head = huffman.read_header(data)
    assert head["sizes"].tolist() == sizes.tolist() and head["doc_ids"].tolist() == [0, 1, 2, 3, 4]
    assert (huffman.decode_blocks(data) == ids).all()
    assert (huffman.decode_blocks(data, 7, 9) == ids[7 * 64 : 9 * 64]).all()
    assert (huffman.decode_blocks(data, 78, 79) == ids[78 * 64 :]).all()
    for one in (np.zeros(10, np.uint32), np.empty(0, np.uint32)):
        lengths = huffman.code_lengths(np.bincount(one, minlength=1)).tobytes()
        assert (huffman.decode_blocks(huffman.encode_file(np.array([1]), np.array([len(one)]), one, lengths)) == one).all()


@pytest.mark.parametrize("file_ids", [2_000_000, 700])
def test_documents(spark, file_ids):
    rows = [(k * 37 % 101, babble(k, 20 * (k % 9))) for k in range(101)] + [(500, None), (501, ""), (None, "x y"), (7, "é"), (502, "word " * 20000), (503, "a<|endoftext|>b"), (-5, "neg")]
    table = docs(spark, rows).withColumnRenamed("lang", "start").withColumnRenamed("source", "ids")
    got = sorted(map(tuple, huffman.round_trip(table, block=50, file_ids=file_ids).collect()), key=lambda r: r[1])
    want = brute(rows)
    assert [g[0] for g in got] == [w[0] for w in want]
    sevens = lambda x: sorted((a[0], *a[2:]) for a in x if a[0] == 7)  # noqa: E731  repeated ids may come in either order
    assert sevens(got) == sevens(want) and [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]
    assert huffman.round_trip(docs(spark, [])).collect() == []


def test_query_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, huffman.op3_huffman_token_files(spark, folder).collect()), key=lambda r: r[1]) == brute(rows)
