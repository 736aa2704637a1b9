"""Spelling variants of a vocabulary: near words by wildcard groups and deletions, without pairs within a group."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import CRC_TABLE_SQL, crc32_sql, documents, slices, texts_of, written

#: Letters of a run, and those of a run after A-Z have become a-z.
LETTERS, LOWERED = r"A-Za-zÀ-ÿ", r"a-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Of a document's words, one in so many (by crc) loses a letter.
TYPO = 199
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Characters of a text whose runs are listed at a time.
PIECE = 1 << 20


def _runs(text: str, pattern: re.Pattern) -> Iterator[str]:
    """Runs of letters in a lower-cased text; long texts are cut where no run is."""
    text = text.encode().translate(_LOWER).decode()
    start = 0
    while len(text) - start > PIECE:
        end = start + PIECE
        while end < len(text) and pattern.match(text, end - 1) and pattern.match(text, end):
            end += 1
        yield from _RUN.findall(text, start, end)
        start = end
    yield from _RUN.findall(text, start)


_RUN, _LETTER = re.compile(f"[{LOWERED}]+"), re.compile(f"[{LOWERED}]")


def _count(least: int, typo: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 << 20):
            counts: Counter[str] = Counter()
            for doc, text in zip(batch.column("doc").to_pylist(), texts_of(batch), strict=True):
                found = Counter(w for w in _runs(text, _LETTER) if len(w) >= least)
                if typo:
                    for w, n in found.items():
                        h = zlib.crc32(f"{doc}:{w}".encode())
                        if h % typo:
                            counts[w] += n
                        elif len(w) > least:
                            k = h % len(w)
                            counts[w[:k] + w[k + 1 :]] += n
                else:
                    counts.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    return run


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, typo: int | None = None) -> DataFrame:
    """The vocabulary of a table: (word, n), with n at least ``least_count``.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) of ``least_length`` code
    points or more, with A-Z lowered. With ``typo`` a word whose hash with its document's id
    is divisible by it loses a letter there first. Null and empty texts have none, a null id
    counts as the word "null", every row of repeated rows counts. Other columns are not
    read. A task sends a word once for each few megabytes of text, so common words are
    summed before they are shuffled.
    """
    picked = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("doc"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    counted = picked.mapInArrow(_count(least_length, typo), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def replacements(words: DataFrame) -> DataFrame:
    """For every word and place, the words that differ from it just there: (word, k of them, best of them as (-n, word)).

    The words that share a place, what is before it and what is after it are a group (of no
    more words than the alphabet has letters). All that a word needs of it is its size and
    its two leading words: the first, or for that one the second.
    """
    place = F.explode(F.expr("transform(sequence(1, length(word)), i -> struct(i AS at, left(word, i - 1) AS prefix, substring(word, i + 1) AS suffix))"))
    keyed = words.select("word", "n", place.alias("p")).select("word", F.struct((-F.col("n")).alias("m"), "word").alias("me"), "p.at", "p.prefix", "p.suffix")
    group = W.partitionBy("at", "prefix", "suffix").orderBy("me").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    seen = keyed.select("word", "me", F.count("*").over(group).alias("size"), F.first("me").over(group).alias("first"), F.nth_value("me", 2).over(group).alias("second"))
    return seen.where("size > 1").select("word", (F.col("size") - 1).alias("k"), F.when(F.col("me") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))


def indels(words: DataFrame, least_length: int) -> DataFrame:
    """The words that are another word less one letter, seen from both: (word, k, best).

    A word's different deletions that are in the vocabulary are its shorter near words, at
    most one for each of its letters; a shorter word's longer ones are counted where they meet it.
    """
    shorter = F.explode(F.expr("array_distinct(transform(sequence(1, length(word)), i -> concat(left(word, i - 1), substring(word, i + 1))))"))
    cut = words.where(F.length("word") > least_length).select(F.struct((-F.col("n")).alias("m"), "word").alias("longer"), shorter.alias("word"))
    met = written(cut.join(words, "word").select("longer", F.struct((-F.col("n")).alias("m"), "word").alias("shorter")), "met")
    down = met.groupBy(F.col("longer.word").alias("word")).agg(F.count("*").alias("k"), F.min("shorter").alias("best"))
    return down.union(met.groupBy(F.col("shorter.word").alias("word")).agg(F.count("*").alias("k"), F.min("longer").alias("best")))


def variants(words: DataFrame, ratio: float = RATIO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """For every word of a vocabulary (word, n): (word, form, root, n, n_near, form_n).

    Words are near if they differ by one inserted, deleted or replaced code point; n_near
    counts them. form is the near word of largest n (of equals the first by code points) if
    that is at least ``ratio`` times the word's own, root is where following forms ends, the
    word itself if it has none. Ratios are over 1, so forms never lead back. An empty
    vocabulary gives no rows. Words are unique and as word_counts gives them: none is
    shorter than ``least_length``.

    Each word goes to as many groups as it has letters; no pair is made within a group, so
    a stem with many variants costs what its variants do.
    """
    if ratio <= 1:
        raise ValueError("ratio is over 1")
    words = written(words.select("word", "n"), "words")
    near = replacements(words).unionByName(indels(words, least_length))
    summed = near.groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))
    led = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    rows = words.join(summed, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(led, F.col("best.word")).alias("form"), F.when(led, -F.col("best.m")).alias("form_n"))
    rows = written(rows, "near")
    return rows.join(_followed(rows), "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def _followed(rows: DataFrame) -> DataFrame:
    """(word, to): where forms lead in the end. Each round doubles the steps; n grows by the ratio a step, so a few rounds reach any end."""
    ways = written(rows.where("form is not null").select("word", F.col("form").alias("to")), "ways")
    while True:
        further = ways.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if ways.join(further, "to", "left_semi").isEmpty():
            return ways
        ways = written(ways.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to")), "ways")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of six letters found five times, after some occurrences have lost a letter."""
    return variants(word_counts(documents(spark, sf_dir), typo=TYPO))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
_H = crc32_sql("coalesce(doc_id::VARCHAR, 'null') || ':' || run")
ORACLES = {
    "op11_spelling_variants": f"""
WITH RECURSIVE crc AS ({CRC_TABLE_SQL}),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL
), hashed AS (SELECT run, n, {_H} AS h FROM runs, crc WHERE length(run) >= {LEAST_LENGTH}),
words AS (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % {TYPO} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
), places AS (SELECT word, n, i, substring(word, 1, i - 1) AS prefix, substring(word, i + 1) AS suffix FROM words, unnest(range(1, length(word) + 1)) AS u(i)),
cuts AS (SELECT DISTINCT word, n, prefix || suffix AS shorter FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM places a JOIN places b ON a.i = b.i AND a.prefix = b.prefix AND a.suffix = b.suffix AND a.word <> b.word
  UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.shorter
  UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.shorter
), ranked AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS place FROM near),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {RATIO} * n THEN other END AS form, CASE WHEN other_n >= {RATIO} * n THEN other_n END AS form_n
  FROM words LEFT JOIN (SELECT * FROM ranked WHERE place = 1) USING (word)
), way AS (
  SELECT word, word AS here FROM formed
  UNION ALL SELECT way.word, formed.form FROM way JOIN formed ON formed.word = way.here WHERE formed.form IS NOT NULL
)
SELECT word, formed.form, way.here AS root, n, n_near, form_n FROM formed JOIN way USING (word) JOIN (SELECT word AS here, form AS further FROM formed) USING (here) WHERE further IS NULL"""
}
