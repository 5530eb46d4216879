"""Fast exact encoding with the tokenizers library: each distinct pre-token is encoded once and its ids reused.

A pre-token's ids never depend on its neighbours in these models, so a text's ids are those of its pre-tokens
in turn. Texts that hold a reserved string, or that the splitter below can't cut as the library does, are
encoded whole by the library.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer
from tokenizers.normalizers import Sequence
from tokenizers.pre_tokenizers import ByteLevel

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism

#: The pre-token patterns of the two vocabulary files, as their descriptions state them.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""


def _latin(pattern: str) -> re.Pattern:
    """The pattern for texts of Latin-1 characters only, with classes spelt out: twice as fast as the general one."""
    every = [chr(i) for i in range(256)]
    of = lambda kind: "".join(re.escape(c) for c in every if unicodedata.category(c)[0] == kind)
    space = r"\t-\r \x85\xa0"
    parts = {r"\p{L}": of("L"), r"\p{N}": of("N"), r"\s": space}
    pattern = pattern.replace(r"\S", f"[^{space}]").replace(r"|\s+", f"|[{space}]+")
    for name, characters in parts.items():
        pattern = re.sub(r"\[[^]]*\]", lambda m, n=name, c=characters: m[0].replace(n, c), pattern)
        pattern = pattern.replace(name, f"[{characters}]")
    return re.compile(pattern)


DEFAULT_BYTE = public_tokenizers.path("byte_bpe_50k.json")
DEFAULT_WORD = public_tokenizers.path("word_bpe_49k.json")


class _Known(dict):
    """Ids of words, as bytes; a word that isn't known is encoded when it is asked for."""

    def __init__(self, library: Tokenizer):
        super().__init__()
        self.encode = library.encode

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = array("I", self.encode(word, add_special_tokens=False).ids).tobytes()
        return ids


class CachedEncoder:
    """encode(texts) gives each text's ids as little-endian unsigned 32-bit bytes.

    The cache starts anew, between texts, when it holds `most` words or more.
    """

    def __init__(self, vocabulary: str, words: bool = False, most: int = 1_500_000):
        self.library = Tokenizer.from_file(vocabulary)
        self.library.encode_special_tokens = True
        self.find_latin = _latin(WORD_PATTERN if words else BYTE_PATTERN).findall
        self.find = regex.compile(WORD_PATTERN if words else BYTE_PATTERN).findall
        self.words, self.most = words, most
        self.reserved = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # a word is normal and cut already: the library has its bytes to look up and merge
        single = Tokenizer.from_file(vocabulary)
        single.normalizer = Sequence([])
        single.pre_tokenizer = ByteLevel(add_prefix_space=False, use_regex=False)
        self.known = _Known(single)

    def _whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """The pre-tokens; of a text of composed Latin letters the fast way, else as the library normalises it."""
        if any(r in text for r in self.reserved):
            return None
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find(self.library.normalizer.normalize_str(text) if self.words else text)
        return self.find_latin(text.lower() if self.words else text)

    def encode(self, texts: list[str]) -> list[bytes]:
        out, get = [], self.known.__getitem__
        for text in texts:
            words = self._cut(text)
            out.append(self._whole(text) if words is None else b"".join(map(get, words)))
            if len(self.known) >= self.most:
                self.known.clear()
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: str, words: bool = False) -> CachedEncoder:
    """One encoder a process: Python workers serve many tasks, and keep what they have learnt."""
    return CachedEncoder(vocabulary, words)
