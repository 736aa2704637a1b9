"""Quality rules on repetition, found with suffix arrays over the words of a document."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, documents, slices, texts_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_REPEAT = 8
MAX_COVERED = 0.35
MAX_LONGEST = 150
#: Bytes of doubling levels that are kept for common prefixes.
LEVELS = 256 << 20


def suffix_ranks(symbols: np.ndarray, text: np.ndarray) -> list[np.ndarray]:
    """Prefix doubling over many texts at once: ranks[k][i] names the 2**k symbols from i on.

    symbols: small non-negative integers; text: the number of each symbol's text, ascending.
    Suffixes end with their text and never equal one of another text. The last ranks are
    all different: their order is the suffix array of every text. Only suffixes that are
    not yet alone with their rank are sorted again. Where the levels come to over LEVELS
    bytes, only the last is returned.
    """
    n = len(symbols)
    if not n:
        return [np.empty(0, np.int64)]
    end = np.searchsorted(text, text, side="right")
    key = text.astype(np.int64) * (int(symbols.max()) + 1) + symbols
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    rank[order] = np.flatnonzero(first)[np.cumsum(first) - 1]  # place of the first of its class
    ranks, step = [rank], 1
    while True:
        size = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(size[rank] > 1)
        if not len(open_):
            return [x for x in ranks if x is not None] if ranks[0] is not None else ranks[-1:]
        after = open_ + step
        nxt = np.where(after < end[open_], rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[open_] * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        key, at = key[order], open_[order]
        new_class = np.concatenate(([True], key[1:] != key[:-1]))
        old = rank[at]
        new_rank = np.concatenate(([True], old[1:] != old[:-1]))
        base = np.flatnonzero(new_rank)[np.cumsum(new_rank) - 1]  # where its old class begins
        within = np.flatnonzero(new_class)[np.cumsum(new_class) - 1] - base
        rank = rank.copy()
        rank[at] = old + within
        if ranks[0] is None or (len(ranks) + 1) * rank.nbytes > LEVELS:
            ranks = [None]
        ranks.append(rank)
        step *= 2


def longest_repeats(symbols: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the length of the longest substring from there that is found again in its text.

    That is the larger of the common prefixes with the two neighbours in the suffix array,
    which are read off the doubling ranks from the longest step to the shortest: the depth
    of the deepest longest-common-prefix interval that holds the suffix. Very long repetitive
    texts have too many levels to keep; there the prefixes are found along the text, each
    at most one shorter than that of the position before.
    """
    n = len(symbols)
    ranks = suffix_ranks(symbols, text)
    order = np.empty(n, np.int64)
    order[ranks[-1]] = np.arange(n)
    if len(ranks) == 1 and ((symbols[order[1:]] == symbols[order[:-1]]) & (text[order[1:]] == text[order[:-1]])).any():  # the other levels went
        return _deepest(order, along(symbols, text, order, ranks[0]))
    i, j = order[:-1].copy(), order[1:].copy()
    common = np.zeros(max(0, n - 1), np.int64)
    live = text[i] == text[j] if n else np.empty(0, bool)
    at = np.flatnonzero(live)
    i, j = i[at], j[at]
    end = np.searchsorted(text, text[i], side="right") if len(at) else np.empty(0, np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = (np.maximum(i, j) + (1 << k)) <= end
        same = inside & (ranks[k][np.minimum(i, n - 1)] == ranks[k][np.minimum(j, n - 1)])
        common[at[same]] += 1 << k
        i, j = i + (same << k), j + (same << k)
    return _deepest(order, common)


def _deepest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    best = np.zeros(len(order), np.int64)
    if len(order) > 1:
        best[order[:-1]] = common
        best[order[1:]] = np.maximum(best[order[1:]], common)
    return best


def along(symbols: np.ndarray, text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Common prefix of each two neighbours in the suffix array, in the order of the text, with no memory but a few arrays."""
    n = len(symbols)
    end = np.searchsorted(text, text, side="right")
    common = np.zeros(n - 1, np.int64)
    s, o, r, e, c = (memoryview(np.ascontiguousarray(x, np.int64)) for x in (symbols, order, rank, end, common))
    have = 0
    for i in range(n):
        if r[i] == n - 1:
            have = 0
            continue
        j = o[r[i] + 1]
        have = have if e[i] == e[j] else 0
        most = min(e[i] - i, e[j] - j) if e[i] == e[j] else 0
        while have < most and s[i + have] == s[j + have]:
            have += 1
        c[r[i]] = have
        have = max(0, have - 1)
    return common


def covered(best: np.ndarray, least: int) -> np.ndarray:
    """Positions in the union of all repeated substrings of at least ``least`` symbols."""
    n = len(best)
    at = np.flatnonzero(best >= least)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + best[at], -1)
    return np.cumsum(edge[:n]) > 0


def repetition(texts: list[str], window: int = WINDOW, min_repeat: int = MIN_REPEAT) -> np.ndarray:
    """Per text: words, words in repeated windows, words in repeats of ``min_repeat`` or more, longest repeat."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    counts, ids = [], []
    for text in texts:
        words = text.encode().split()
        counts.append(len(words))
        ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
    n = np.array(counts, np.int64)
    symbols = np.concatenate(ids) if ids else np.empty(0, np.int64)
    text = np.repeat(np.arange(len(texts)), n)
    best = longest_repeats(symbols, text)
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, text, best)
    again, spans = (np.bincount(text[covered(best, least)], minlength=len(texts)) for least in (window, min_repeat))
    return np.stack([n, again, spans, longest])


def quality(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_again: int = 50, window: int = WINDOW, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, carry: tuple[str, ...] = ()
) -> DataFrame:
    """One row per document with its word statistics and the verdict.

    Columns: doc_id, n_words, word_chars (code points in words), n_symbols (characters of
    ``[#*$%&|<>]``), n_dup_lines (lines with a word, equal to an earlier line),
    n_repeat_words (words in windows of ``window`` words found twice or more), base_failed
    (under ``min_words`` words, or more than ``max_again`` percent of them repeated), kept,
    n_span_words (words in the union of the repeated substrings of ``min_repeat`` words or
    more) and longest_repeat (words). A text is kept if base_failed is false, its spans are
    at most ``max_covered`` of its words and no repeat is longer than ``max_longest`` words.

    Columns named in ``carry`` come along, after those (a text to carry is not read twice).
    A null or empty text has no words and fails. A null id keeps its row; repeated rows are
    judged alone; other columns are not read. Texts are dealt out by size in bytes, so long ones
    share no suffix array with many others; one text is the least a task holds.
    """
    carried = [f"c{k}" for k in range(len(carry))]
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c).alias(n) for c, n in zip(carry, carried, strict=True) if c != text_col])
    source = ["text" if c == text_col else n for c, n in zip(carry, carried, strict=True)]
    more = [f"`{n}` {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, carried, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=1 << 20):
            texts = texts_of(batch)
            n, again, spans, longest = repetition(texts, window, min_repeat)
            chars = np.array([len(t) - sum(map(t.count, BLANKS)) for t in texts], np.int64)
            symbols = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
            again_lines = np.zeros(len(texts), np.int64)
            for k, t in enumerate(texts):
                lines = [x for x in t.split("\n") if x.strip(BLANKS)]
                again_lines[k] = len(lines) - len(set(lines))
            failed = (n < min_words) | (100 * again > max_again * n)
            kept = ~failed & (spans <= max_covered * n) & (longest <= max_longest)
            columns = [n, chars, symbols, again_lines, again, failed, kept, spans, longest]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), *map(batch.column, source)], [*names, *carried])

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_span_words", "longest_repeat"]
    kinds = ["long"] * 6 + ["boolean"] * 2 + ["long"] * 2
    out = picked.mapInArrow(run, ", ".join([*(f"{a} {b}" for a, b in zip(names, kinds, strict=True)), *more]))
    return out.select(*names, *[F.col(n).alias(c) for n, c in zip(carried, carry, strict=True)])


def op7_quality_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every document."""
    return quality(documents(spark, sf_dir)).drop("longest_repeat")


QUERIES = {"op7_quality_repetition": op7_quality_repetition}


def _windows(width: int) -> str:
    """Windows of so many words that are found again in their text, and the words in their union."""
    return f"""w{width} AS (
  SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(w[i : i + {width - 1}], ' ')) > 1 AS again
  FROM (SELECT row, w, unnest(range(1, len(w) - {width - 2})) AS i FROM worded)
), u{width} AS (
  SELECT row, count(DISTINCT i + k) AS n FROM w{width}, (SELECT unnest(range(0, {width})) AS k) WHERE again GROUP BY row
)"""


#: The words in repeats of at least m words are those in windows of m words found twice; a repeat is longer than L words where a window of L + 1 is.
ORACLES = {
    "op7_quality_repetition": rf"""
WITH worded AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), {_windows(WINDOW)}, {_windows(MIN_REPEAT)}, long AS (
  SELECT DISTINCT row FROM (
    SELECT row, count(*) OVER (PARTITION BY row, md5(array_to_string(w[i : i + {MAX_LONGEST}], ' '))) > 1 AS again
    FROM (SELECT row, w, unnest(range(1, len(w) - {MAX_LONGEST - 1})) AS i FROM worded)) WHERE again
), counted AS (
  SELECT row, doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(u{WINDOW}.n, 0)::BIGINT AS n_repeat_words, coalesce(u{MIN_REPEAT}.n, 0)::BIGINT AS n_span_words, long.row IS NOT NULL AS too_long
  FROM worded LEFT JOIN u{WINDOW} USING (row) LEFT JOIN u{MIN_REPEAT} USING (row) LEFT JOIN long USING (row)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_span_words <= {MAX_COVERED}::DOUBLE * n_words AND NOT too_long AS kept, n_span_words
FROM judged"""
}
