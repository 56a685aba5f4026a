"""Ids of a byte-level BPE from its tokenizers file, and the bytes of its tokens.

The tokenizers library looks every piece of text up again; a rank encoder that holds the same vocabulary gives the same
ids in a fraction of the time, so it does the work where both are known to agree: the file has the usual pieces (letters,
digits, other characters, each with one space before) and merges in the order of their ids, and the text has only
characters whose kind no Unicode version since 3.2 changed, and none of the special tokens. All else goes to the library itself.
Without two white-space characters in a row the pieces need no look-ahead, which is faster again.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np

_TWO_SPACES = re.compile(r"\s\s")
# The pieces of the vocabulary's pre-tokenizer.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"


def _letters() -> dict[str, int]:
    """The character that stands for each byte: printable ones for themselves, the others in order from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteBpe:
    """``encode(texts)`` gives a list of ids for each text. With ``plain``, special tokens inside a text are plain text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = plain
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        letters, special = _letters(), [t["content"] for t in found["added_tokens"]]
        vocab = found["model"]["vocab"]
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in found["added_tokens"])]))
        for t in found["added_tokens"]:
            self.bytes[t["id"]] = t["content"].encode()
        for token, i in vocab.items():
            if token not in special:
                self.bytes[i] = bytes(letters[c] for c in token)
        self.special = None if plain or not special else re.compile("|".join(map(re.escape, special)))
        self.ranks = self.ranks_by_space = None
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in found["model"]["merges"]]
        before = found["pre_tokenizer"] or {}
        usual = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not found["normalizer"]
        if usual and all(a < b for a, b in zip(merged, merged[1:], strict=False)):
            import tiktoken

            ranks = {self.bytes[i]: i for t, i in vocab.items() if t not in special}
            self.ranks = tiktoken.Encoding("pieces", pat_str=_PIECES + r"|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
            self.ranks_by_space = tiktoken.Encoding("pieces-apart", pat_str=_PIECES + r"|\s", mergeable_ranks=ranks, special_tokens={})
        self.settled: set[str] = set()

    def _agreed(self, text: str) -> bool:
        if self.ranks is None or self.special and self.special.search(text):
            return False
        if text.isascii():
            return True
        new = set(text) - self.settled
        kept = {c for c in new if unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c) != "Cn"}
        self.settled |= kept
        return len(kept) == len(new)

    def _ids(self, text: str) -> list[int]:
        if not self._agreed(text):
            return self.library.encode(text, add_special_tokens=False).ids
        return (self.ranks if _TWO_SPACES.search(text) else self.ranks_by_space).encode_ordinary(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._ids(t) for t in texts]


@lru_cache(maxsize=4)
def byte_bpe(path: str, plain: bool = False) -> ByteBpe:
    """One encoder per worker and file."""
    return ByteBpe(path, plain)


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def flat(codes: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(all ids, number of ids of each text)."""
    counts = np.fromiter(map(len, codes), np.int64, len(codes))
    return np.fromiter((i for c in codes for i in c), np.int64, int(counts.sum())), counts
