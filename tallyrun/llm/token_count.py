"""Token counts by byte-pair merging with a heap and a linked list, without emitting ids."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import documents, slices, texts_of
from .vocab import byte_letters

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: Words and pieces of at most so many characters that a Python worker remembers before it starts anew.
MEMORY, SHORT = 400_000, 48
#: Unicode White_Space, which is what the file's normalizer and pattern split at.
WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def merged(symbols: list, ranks: dict) -> int:
    """Symbols left after byte-pair merging: their number at first minus the merges.

    The symbols form a doubly linked list; a heap holds the rank of every adjacent pair that
    can merge. The lowest rank (the leftmost of equals) is popped, a pair that has changed
    since is passed over, the right symbol goes, and the two new neighbours are pushed.
    """
    n = len(symbols)
    if n < 2:
        return n
    symbols = list(symbols)
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]
    heap = []
    for i in range(n - 1):
        found = ranks.get((symbols[i], symbols[i + 1]))
        if found is not None:
            heap.append((found[0], i, found[1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        rank, i, new = heapq.heappop(heap)
        j = right[i]
        if symbols[i] is None or j < 0:
            continue
        now = ranks.get((symbols[i], symbols[j]))
        if now is None or now[0] != rank:
            continue
        symbols[i], symbols[j] = new, None
        k = right[i] = right[j]
        if k >= 0:
            left[k] = i
            found = ranks.get((new, symbols[k]))
            if found is not None:
                heapq.heappush(heap, (found[0], i, found[1]))
        h = left[i]
        if h >= 0:
            found = ranks.get((symbols[h], new))
            if found is not None:
                heapq.heappush(heap, (found[0], h, found[1]))
        merges += 1
    return n - merges


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """One per Python worker and file."""
    return Counter(path)


class Counter:
    """Token counts under a word BPE file: NFC, white space to one blank, lower case, words by a pattern, bytes as letters, a word end.

    All this works within pieces between white space, so counts are summed over pieces,
    each counted when first seen.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {(a, b): (rank, a + b) for rank, (a, b) in enumerate(map(tuple, pairs))}
        self.vocab = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        special = [t["content"] for t in file["added_tokens"]]
        self.special, self.specials = re.compile("(" + "|".join(map(re.escape, special)) + ")"), set(special)
        self.pattern = regex.compile(file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.letters = byte_letters()
        self.controls = re.compile("[\x1c-\x1f]")
        self.white = re.compile(f"[{WHITE}]+")
        self.library = lru_cache(1)(lambda: Tokenizer.from_file(path))
        self.words: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            symbols = [self.letters[b] for b in word.encode()]
            symbols[-1] += self.end
            n = merged([s for s in symbols if s in self.vocab], self.ranks)
            if len(word) <= SHORT:
                if len(self.words) >= MEMORY:
                    self.words.clear()
                self.words[word] = n
        return n

    def piece(self, piece: str) -> int:
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            # Characters that this Python's Unicode does not know yet may be letters to the library.
            return len(self.library().encode(piece, add_special_tokens=False).ids)
        n = 0
        for part in self.special.split(piece):
            if part in self.specials:
                n += 1
                continue
            if part.isascii():
                low = part.lower()
            else:  # letter by letter: no final sigma
                low = "".join([c.lower() for c in unicodedata.normalize("NFC", part)])
            n += sum(map(self.word, self.pattern.findall(low)))
        return n

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        pieces = self.white.split(text) if self.controls.search(text) else text.split()
        known = self.pieces
        try:
            return sum([known[p] for p in pieces])
        except KeyError:
            pass
        n = 0
        for p in pieces:
            c = known.get(p)
            if c is None:
                c = self.piece(p)
                if len(p) <= SHORT:
                    if len(known) >= MEMORY:
                        known.clear()
                    known[p] = c
            n += c
        return n


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_tokens, over_limit).

    tokenizer: the place of a word BPE file on every node. Counts equal those of the
    library for that file, without begin, end or added special tokens; special strings in a
    text count as one token each, as they do there by default. A null text counts as empty
    (0 bytes, 0 tokens), texts are never cut, a null id keeps its row, repeated rows are
    counted each, other columns are not read.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).count
        for batch in slices(batches):
            texts = texts_of(batch)
            size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], np.int64)
            n = np.array(list(map(count, texts)), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return picked.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document under the 49k word BPE."""
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(TOKENIZER))


QUERIES = {"op1_token_counts": op1_token_counts}
ORACLES: dict[str, str] = {}
