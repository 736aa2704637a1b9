import corpus_pipeline as cp
from tallyrun.llm import mixing, quality

from . import test_near_copies, test_packing, test_quality
from .helpers import babble, docs


def brute_repeats(rows):
    first = {}
    for i, d in rows:
        for s in range(len(d) - 99):
            w = d[s : s + 100]
            first[w] = min(first.get(w, (i, s)), (i, s))
    out = {}
    for i, d in rows:
        gone = bytearray(len(d))
        for s in range(len(d) - 99):
            if first[d[s : s + 100]] < (i, s):
                gone[s : s + 100] = b"\1" * 100
        out[i] = bytes(b for b, g in zip(d, gone) if not g) if any(gone) else None
    return out


def expected(rows, take):
    """What each stage keeps, by brute force; rows by id. take: copies of a list of (id, text, source)."""
    kept = {i: (t, s) for i, t, s in rows if test_quality.naive(t)[6]}
    groups = test_near_copies.brute([(i, t) for i, (t, _) in kept.items()])
    kept = {i: x for i, x in kept.items() if groups[i] == i}
    cut = brute_repeats([(i, t.encode()) for i, (t, _) in kept.items()])
    kept = {i: (t if cut[i] is None else cut[i].decode("utf-8", "ignore"), s) for i, (t, s) in kept.items()}
    copies = take([(i, t, s) for i, (t, s) in kept.items()])
    return [(i, t) for i, (t, _) in kept.items() for _ in range(copies[i])]


def taker(spark):
    def take(rows):
        table = docs(spark, [(i, t, "en", s, len(t)) for i, t, s in rows])
        return {r.doc_id: r.copies for r in mixing.mix(table).collect()}  # itself tested against its SQL and naive targets

    return take


def test_run_on_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").collect()]
    want = expected(rows, taker(spark))
    used, least = test_packing.check(want, cp.run(spark, folder).collect())
    assert used <= 1.02 * least + 1


def test_stages_with_nulls_copies_and_passages(spark, tmp_path):
    passage = babble(900, 60, 5000)
    rows = [(k, babble(k, 70 + k % 40, 5000), f"s{k % 3}") for k in range(40)]
    rows += [(50, rows[3][1], "s0"), (51, rows[4][1] + " end", "s1"), (52, None, "s1"), (53, "", None), (54, babble(54, 90, 5000) + " " + passage, None), (55, babble(55, 90, 5000) + " " + passage, "s2"), (56, "é" * 3000 + " " + babble(56, 80, 5000), "s2")]
    docs(spark, [(i, t, "en", s, len(t or "")) for i, t, s in rows]).write.parquet(str(tmp_path / "documents.parquet"))
    test_packing.check(expected(rows, taker(spark)), cp.run(spark, str(tmp_path)).collect())


def test_null_and_repeated_ids_in_every_stage(spark):
    """Rows are rows whatever their id: a stage drops what it rejects and nothing else."""
    good = [babble(k, 90 + k, 5000) for k in range(12)]
    rows = [(1, good[0]), (1, good[0]), (1, good[1]), (None, good[2]), (None, good[3]), (None, good[3]), (5, good[4]), (5, good[5]), (6, "too few words"), (None, None), (None, ""), (7, good[5] + " end")]
    docs_ = docs(spark, [(i, t, None if k % 5 == 0 else "en", None if k % 4 == 0 else f"s{k % 2}", None) for k, (i, t) in enumerate(rows)])

    def held(df):
        return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)

    judged = cp.quality_rules(spark, docs_, "")
    assert held(judged) == sorted(((i, t) for i, t in rows if test_quality.naive(t)[6]), key=str)
    single = cp.near_dedup(spark, docs_, "")
    texts = {t or "" for _, t in rows} - {good[5] + " end"}
    got = held(single)
    assert len(got) == len(texts) and {t or "" for _, t in got} == texts and (None, good[3]) in got and (5, good[5]) in got
    cut = cp.string_dedup(spark, docs_, "").collect()
    # Rows of one id are parts of one document at the same places; of null ids as well.
    assert len(cut) == len(rows) and sorted(len(r.text or "") for r in cut) == sorted(len(t or "") if t != good[5] + " end" else 4 for _, t in rows)
    mixed = held(cp.source_mix(spark, docs_, ""))
    assert set(mixed) <= {(i, t) for i, t in rows} and all(mixed.count(x) <= 3 * [(i, t) for i, t in rows].count(x) for x in mixed)
    packed = cp.best_fit_packing(spark, docs_, "").collect()
    assert sum(r.doc_id is None for r in packed) >= 5 and sum(r.doc_id == 1 for r in packed) >= 3


def test_empty_table_and_columns(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []
    some = docs(spark, [(1, babble(1, 80, 5000)), (2, babble(2, 80, 5000))])
    for _, stage in cp.STAGES[:-1]:
        some = stage(spark, some, "")
        assert some.columns == cp.COLUMNS


def test_each_stage_has_its_operator():
    assert len(cp.STAGES) == 5 and cp.ORACLE_SQL is None and quality.MIN_REPEAT == 8
