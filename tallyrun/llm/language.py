"""Languages of mixed texts: scripts narrow the candidates, Viterbi over word scores labels the spans."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, slices, texts_of

UNKNOWN = "und"
#: Labelled documents per language that the model is fitted on, chosen by the hash of their id.
TRAIN_DOCS = 400
#: Cost, in nats, of a change of language between two words.
SWITCH = 8.0
#: Words and letters that a Python worker remembers before it starts anew.
MEMORY, MEMORY_LETTERS = 300_000, 8 << 20
#: Letter runs whose scores in all languages are held at a time.
RUNS = 1 << 17

# First and last code point of the blocks that hold most letters of a script, by Unicode's block list.
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0B80, 0x0BFF, "Tamil"), (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"),
    (0x1E00, 0x1EFF, "Latin"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
_FIRST = np.array([s[0] for s in SCRIPTS])
_LAST = np.array([s[1] for s in SCRIPTS])
NAMES = sorted({s[2] for s in SCRIPTS}) + ["Other"]
_NAME = np.array([NAMES.index(s[2]) for s in SCRIPTS])
_NOT_LETTERS = re.compile(r"(?:[^\w\n]|[\d_])+")
#: Letter runs are counted under this many numbers for each length; runs that share one are counted together.
SLOTS = 1 << 17
LENGTHS = (2, 3, 4)


def scripts_of(letters: np.ndarray) -> np.ndarray:
    """The number in NAMES of each code point's script."""
    k = np.searchsorted(_FIRST, letters, side="right") - 1
    return np.where((k >= 0) & (letters <= _LAST[k]), _NAME[k], len(NAMES) - 1)


def letter_words(text: str) -> list[str]:
    """Words between blanks, without those that have no letter (of Unicode's letter categories; number signs are none)."""
    return [w for w in text.split() if w.isalpha() or any(map(str.isalpha, w))]


def letter_runs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words: the numbers of all their letter runs, the place of each word's first run, and the letters by word with an edge mark after each.

    A word is its letters in lower case between two edge marks; its runs are those of 2, 3
    and 4 letters and marks.
    """
    low = unicodedata.normalize("NFC", "\n".join(words)).lower()
    text = _NOT_LETTERS.sub("", low)
    if not text.isascii():
        text = "".join([c for c in text if c.isalpha() or c == "\n"])
    text = "\n" + text + "\n"
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    edge = np.flatnonzero(points == 10)
    word = np.repeat(np.arange(len(words)), np.diff(edge))  # of each point but the last
    left = np.repeat(edge[1:], np.diff(edge)) - np.arange(len(word))  # points to the next edge
    runs, owners, have = [], [], points
    for n in range(2, max(LENGTHS) + 1):
        have = (have[:-1] * np.uint64(0x100000001B3)) ^ (points[n - 1 :] * np.uint64(0x9E3779B97F4A7C15))
        if n in LENGTHS:
            at = np.flatnonzero(left[: len(have)] >= n - 1)
            mixed = have[at] * np.uint64(0xD6E8FEB86659FD93)
            runs.append((mixed >> np.uint64(47)).astype(np.int64) + SLOTS * LENGTHS.index(n))
            owners.append(word[at])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(runs)[order], np.searchsorted(owner[order], np.arange(len(words))), points


class Model:
    """Scores of words by language: naive Bayes over letter runs, among the languages of the word's script.

    counts: for each language how often each letter run occurs; scripts: for each language
    how many letters of each script. A language is a candidate for a script if this has at
    least one of a hundred of its letters; a script that no language has leaves all. The
    script of a word is that of its first letter.
    """

    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        n = len(self.langs)
        self.table = np.zeros((SLOTS * len(LENGTHS), n))
        for j, lang in enumerate(self.langs):
            self.table[:, j] = np.log(counts[lang] + 0.3) - np.log(counts[lang].sum() + 0.3 * SLOTS)
        self.allowed = np.zeros((len(NAMES), n))
        for k in range(len(NAMES)):
            ok = np.array([100 * scripts[x][k] >= scripts[x].sum() > 0 for x in self.langs], bool)
            if ok.any():
                self.allowed[k] = np.where(ok, 0.0, -50.0)
        self.words: dict[str, int] = {}
        self.letters = 0
        self.scores = np.zeros((0, n), np.float32)

    def _sums(self, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The scores of each word's runs, added up. A word may be longer than the runs held at a time."""
        out = np.zeros((len(first), len(self.langs)))
        for at in range(0, len(runs), RUNS):
            some = runs[at : at + RUNS]
            a, b = np.searchsorted(first, at, side="right") - 1, np.searchsorted(first, at + len(some), side="left")
            out[a:b] += np.add.reduceat(self.table[some], np.maximum(first[a:b] - at, 0), axis=0)
        return out

    def word_scores(self, words: list[str]) -> np.ndarray:
        """A row per word: the log-likelihood of each language less the best one's, at least -12 among the candidates."""
        missing = [w for w in dict.fromkeys(words) if w not in self.words]
        if missing:
            if len(self.words) + len(missing) > MEMORY or self.letters > MEMORY_LETTERS:
                self.words, self.scores, self.letters = {}, self.scores[:0], 0
                missing = list(dict.fromkeys(words))
            self.letters += sum(map(len, missing))
            runs, first, points = letter_runs(missing)
            new = self._sums(runs, first)
            new = np.maximum(new - new.max(axis=1, keepdims=True), -12.0)
            new += self.allowed[scripts_of(points[np.flatnonzero(points == 10)[:-1] + 1])]
            new -= new.max(axis=1, keepdims=True)
            start = len(self.scores)
            self.words.update(zip(missing, range(start, start + len(missing)), strict=True))
            self.scores = np.concatenate((self.scores, new.astype(np.float32)))
        return self.scores[np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[str], switch: float = SWITCH) -> list[np.ndarray]:
        """The language number of every letter word of each text: the path of the highest sum of scores less ``switch`` for each change.

        All texts go forward together, a word of each at a time, the long ones last to end.
        """
        words = [letter_words(t) for t in texts]
        sizes = np.array([len(w) for w in words], np.int64)
        if not self.langs or not sizes.any():
            return [np.zeros(s, np.int32) for s in sizes]
        order = np.argsort(-sizes, kind="stable")
        flat = self.word_scores([w for k in order for w in words[k]])
        sorted_sizes = sizes[order]
        begin = np.cumsum(sorted_sizes) - sorted_sizes
        n, most = len(self.langs), int(sizes.max(initial=0))
        live = np.searchsorted(-sorted_sizes, -np.arange(most), side="left")  # texts with more than t words
        stay = np.zeros((len(flat), n), bool)
        best_before = np.zeros(len(flat), np.int32)
        value = np.zeros((len(texts), n))
        for t in range(most):
            m = live[t]
            at = begin[:m] + t
            if t:
                top = value[:m].argmax(axis=1)
                jump = value[np.arange(m), top][:, None] - switch
                stay[at] = value[:m] >= jump
                best_before[at] = top
                value[:m] = np.maximum(value[:m], jump) + flat[at]
            else:
                value[:m] = flat[at]
        path = np.zeros(len(flat), np.int32)
        now = value.argmax(axis=1)
        for t in range(most - 1, -1, -1):
            m = live[t]
            at = begin[:m] + t
            path[at] = now[:m]
            if t:
                now[:m] = np.where(stay[at, now[:m]], now[:m], best_before[at])
        out: list = [None] * len(texts)
        for k, b, s in zip(order.tolist(), begin.tolist(), sorted_sizes.tolist(), strict=True):
            out[k] = path[b : b + s]
        return out


def fit(docs: DataFrame, labelled: F.Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_DOCS) -> Model:
    """A model of the languages of the labelled documents.

    Of each language the ``per_language`` ids with the least hash are taken, and the documents
    of these ids whole (repeated ids count as one). Their letter runs are counted in parallel and only the counts are
    collected, so what reaches the driver is bounded by that number and the languages.
    """
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.approx_count_distinct(id_col, 0.02).alias("n")).toLocalIterator()}
    if not sizes:
        return Model({}, {})
    # Only hashes low enough for about four times the documents wanted go into the ranking.
    span = 1 << 40
    most = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(span, 4 * per_language * span // n + 1))])
    low = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(id_col), F.lit(span)).alias("h")).where(F.col("h") < most[F.col("lang")]).distinct()
    picked = low.withColumn("n", F.row_number().over(W.partitionBy("lang").orderBy("h", "id"))).where(F.col("n") <= per_language)
    chosen = picked.select(F.col("id").alias("chosen"), F.col("lang").alias("of"))
    texts = rows.join(F.broadcast(chosen), (F.col(id_col) == F.col("chosen")) & (F.col(lang_col) == F.col("of")), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), texts_of(batch), strict=True):
                words = letter_words(text)
                if words:
                    runs, _, points = letter_runs(words)
                    mine = sums.setdefault(lang, np.zeros(SLOTS * len(LENGTHS) + len(NAMES), np.int64))
                    mine[: SLOTS * len(LENGTHS)] += np.bincount(runs, minlength=SLOTS * len(LENGTHS))
                    mine[SLOTS * len(LENGTHS) :] += np.bincount(scripts_of(points[points != 10]), minlength=len(NAMES))
        for lang, mine in sums.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(mine[at])], ["lang", "number", "n"])

    rows = texts.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "lang string, number long, n long")
    counts: dict[str, np.ndarray] = {}
    for r in rows.groupBy("lang", "number").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r.lang, np.zeros(SLOTS * len(LENGTHS) + len(NAMES), np.int64))[r.number] = r.n
    cut = SLOTS * len(LENGTHS)
    return Model({x: c[:cut] for x, c in counts.items()}, {x: c[cut:] for x, c in counts.items()})


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", switch: float = SWITCH) -> DataFrame:
    """One row per document: (doc_id, lang_pred, score, spans).

    spans: runs of words of one language as (lang, words), in order, over the words with a
    letter. lang_pred is the language of most of these words (the first in name order of
    equals), score its share of them. A text that is null or has no letter, or any text under an
    empty model, is ``und`` with score 0. Texts are whole, repeated rows and null ids are
    kept, other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in slices(batches, size=8 << 20):
            preds, scores, spans = [], [], []
            for path in model.label(texts_of(batch), switch):
                if not len(path) or not model.langs:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    spans.append([])
                    continue
                n = np.bincount(path, minlength=len(model.langs))
                preds.append(model.langs[int(n.argmax())])
                scores.append(float(n.max() / len(path)))
                cuts = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1], [True])))
                spans.append([{"lang": model.langs[path[a]], "words": b - a} for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return picked.mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang:string,words:long>>")


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def op5_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


QUERIES = {"op5_language_spans": op5_language_spans}
ORACLES: dict[str, str] = {}
