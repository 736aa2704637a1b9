"""Encoding whole texts with a byte-level BPE tokenizer file."""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers


def byte_letters() -> list[str]:
    """The letter that byte-level files write for each byte: printable Latin-1 as itself, the rest from U+0100 on."""
    plain = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One per Python worker and file."""
    return Encoder(path)


class Encoder:
    """Ids of texts under a byte-level BPE file of the tokenizers library, without added special tokens.

    The file's own vocabulary, merges and special tokens are used; texts are encoded by
    tiktoken's engine, which is several times faster than the library and gives the same ids
    where every merge makes the next id, as is checked here. Special strings in a text become
    their ids, as they do in the library by default.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, before = file["model"], file["pre_tokenizer"]
        if file["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE file")
        byte = {letter: b for b, letter in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        if any(model["vocab"][a + b] != 256 + k for k, (a, b) in enumerate(pairs)):
            raise ValueError(f"{path} does not number its merges in order")
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.engine = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text as uint32."""
        if any(special in text for special in self.special):
            return self.engine.encode_to_numpy(text, allowed_special="all")
        return self.engine.encode_to_numpy(text, disallowed_special=())


def crc32(ids: np.ndarray) -> int:
    """Of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
