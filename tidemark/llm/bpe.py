"""Byte-level BPE over whole texts, a word at a time and each word once.

The tokenizer's split pattern always begins a new piece before a space that a
character other than white space follows. So the ids of a text are the ids of
its space-led pieces joined, and a bounded cache of pieces does nearly all of
the work. Texts for which that reasoning fails (two spaces in a row are merged
into longer pieces; a special token's own string; runs of white space so long
that tiktoken's matcher would exhaust its stack) are handled exactly as well.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

#: Characters of the pieces kept per Python worker, beyond which the cache starts afresh (some 20 bytes each), and of the longest of them.
CACHE_CHARS, CACHED_PIECE = 1_000_000, 64

#: A run of white space from which on a text goes to tokenizers whole; tiktoken panics somewhere beyond 300,000.
LONG_SPACE = re.compile(r"\s{50000}")

_LOADED: dict[str, "PieceCachedBpe"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter by which byte-level BPE files write each byte, to that byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PieceCachedBpe:
    """Ids of whole texts as little-endian unsigned 32-bit bytes.

    Pieces are encoded by tiktoken from the JSON file's own vocabulary, several
    times as fast as by tokenizers; both give the same ids, which loading checks
    on a few strings and the tests on many. Texts that contain the string of a
    special token, or a very long run of white space, go to tokenizers whole,
    which is loaded again for them: few workers need it in memory.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken

        self.path, whole = path, self._tokenizer(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items()
            if token not in self.special
        }
        self.fast = tiktoken.Encoding(
            "from-file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        for s in ("a", " the end.", "Ünï 漢字 \t\n 12ab's"):
            if self.fast.encode_ordinary(s) != whole.encode(s, add_special_tokens=False).ids:
                raise ValueError(f"{path} isn't byte-level BPE of the public pattern")
        #: Bytes of each id.
        self.widths = np.zeros(max(max(ranks.values()), *(t["id"] for t in spec["added_tokens"])) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        for t in spec.get("added_tokens", []):
            self.widths[t["id"]] = len(t["content"].encode())
        self._new_cache()

    @staticmethod
    def _tokenizer(path: str):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(path)

    @cached_property
    def whole(self):
        return self._tokenizer(self.path)

    def rest(self) -> None:
        """Forget what another task can do without."""
        self.__dict__.pop("whole", None)
        self._new_cache()

    def _new_cache(self) -> None:
        fast, pack = self.fast, self._pack

        class Cache(dict):
            """Words to packed ids of a space and the word; odd ones to None."""

            chars = 0

            def __missing__(cache, word):
                if not word or word[0].isspace():
                    return None
                if word[-1] in ".,":
                    stem = word[:-1]
                    if stem and stem[-1].isalpha() and (ids := cache[stem]) is not None:
                        return cache.keep(word, ids + pack(fast.encode_ordinary(word[-1])))
                return cache.keep(word, pack(fast.encode_ordinary(" " + word)))

            def keep(cache, word, ids):
                if len(word) <= CACHED_PIECE:
                    cache[word] = ids
                    cache.chars += len(word)
                return ids

        self.cache = Cache()

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """Packed ids of the whole text, nothing added; null is empty."""
        if not text:
            return b""
        if any(s in text for s in self.special) or len(text) >= 50_000 and LONG_SPACE.search(text):
            return self._pack(self.whole.encode(text, add_special_tokens=False).ids)
        if self.cache.chars > CACHE_CHARS:
            self._new_cache()
        words = text.split(" ")
        try:
            return self._pack(self.fast.encode_ordinary(words[0])) + b"".join(
                map(self.cache.__getitem__, words[1:])
            ) if words[0] and not words[0][0].isspace() else self._by_pieces(words)
        except TypeError:  # a piece that can't stand alone
            return self._by_pieces(words)

    def _by_pieces(self, words: list[str]) -> bytes:
        out, piece = [], words[0]
        for word in words[1:]:
            if not word or word[0].isspace():
                piece += " " + word
            else:
                out.append(piece)
                piece = " " + word
        out.append(piece)
        return b"".join(self._pack(self.fast.encode_ordinary(p)) for p in out)


def load(path: str) -> PieceCachedBpe:
    """One tokenizer and cache per Python worker and path."""
    if path not in _LOADED:
        _LOADED[path] = PieceCachedBpe(path)
    return _LOADED[path]
