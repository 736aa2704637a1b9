import hashlib
import random
import zlib

import duckdb
import pytest

from tallyrun.llm import merkle
from tests.llm.helpers import DOC, babble


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The root, and of each leaf its (left, right) siblings from below."""
    steps, at = [[] for _ in hashes], [[k] for k in range(len(hashes))]
    while len(hashes) > 1:
        up, over = [], []
        for k in range(0, len(hashes), 2):
            pair = hashes[k : k + 2]
            for x in at[k]:
                steps[x].append(("", pair[1] if len(pair) == 2 else ""))
            for x in at[k + 1] if len(pair) == 2 else []:
                steps[x].append((pair[0], ""))
            up.append(sha("".join(pair)))
            over.append([x for node in at[k : k + 2] for x in node])
        hashes, at = up, over
    return hashes[0], steps


def brute(rows):
    """Expected rows, in any order."""
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    subs = {}
    for name in names:
        langs[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        subs[name] = tree([leaf(*r) for r in langs[name]])
    root, top = tree([subs[n][0] for n in names]) if names else (None, [])
    out = []
    for k, name in enumerate(names):
        for r, steps in zip(langs[name], subs[name][1], strict=True):
            steps = steps + top[k]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            h = leaf(*r[:4], r[4] + 1) if hit else leaf(*r)
            for a, b in steps:
                h = sha(a + h + b)
            out.append((r[0], leaf(*r), subs[name][0], root, sha("".join(a + b for a, b in steps)), h, h == root))
    return sorted(out, key=repr)


def table(n):
    r = random.Random(n)
    rows = [(k, babble(k, r.randint(0, 30)), r.choice(["en", "en", "en", "de", None, "é", ""]), r.choice([None, "s:1", ""]), r.choice([None, 5, k])) for k in range(n)]
    return rows + [(3, None, "en", "s", 1), (3, None, "en", "s", 1), (None, "no id", "en", "s", 2), (None, "no id", None, None, None), (-7, "x" * 300_000, "one", "s", 9)]


@pytest.mark.parametrize("n,levels", [(0, 12), (40, 12), (300, 2), (300, 3)])
def test_matches_brute_force(spark, n, levels):
    """Two or three levels a block make trees of several stages of blocks."""
    rows = table(n)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, pos int, tree string").repartition(3)
    got = merkle.manifest(docs, altered=merkle.tampered(docs), levels=levels)
    assert sorted((tuple(x) for x in got.drop("lefts", "rights").collect()), key=repr) == brute(rows)


def test_empty_and_single(spark):
    assert merkle.manifest(spark.createDataFrame([], DOC)).collect() == []
    only = merkle.manifest(spark.createDataFrame([(1, "a", "en", "s", 1)], DOC)).collect()[0]
    assert only.leaf == only.root == only.subroot == only.folded_root == leaf(1, "a", "en", "s", 1)
    assert only.lefts == only.rights == [] and only.proof_sha256 == sha("") and only.verified


def test_sizes_around_a_block(spark):
    for n in (3, 4, 5, 16, 17):
        rows = [(k, f"t{k}", "en", "s", k) for k in range(n)]
        got = merkle.manifest(spark.createDataFrame(rows, DOC), levels=2)
        assert {r.root for r in got.collect()} == {tree([leaf(*r) for r in rows])[0]}


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    got = merkle.op12_merkle_manifest(spark, folder)
    sql = con.sql(merkle.ORACLES["op12_merkle_manifest"])
    assert sorted(map(tuple, got.select(*sql.columns).collect())) == sorted(sql.fetchall())
    found = got.groupBy("verified").count().collect()
    assert {r.verified for r in found} == {True, False}
