"""Token ids of whole texts by the public word-end BPE vocabulary.

The vocabulary's rules cut a text at white space, so the ids of a text are those of its
blank-separated chunks one after another.  Chunks repeat, and a bounded cache in each
worker maps those of at most ``CACHE_CHARS`` characters to ids; when half of it is full, that half becomes the older one, and what is
asked for again moves from there to the newer.  Texts with characters for which this has not been shown to be the same (anything
beyond Latin-1, or what may be a special token) go through the library's own encoder.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

#: A file of the installed package of public vocabularies.
VOCABULARY = "word_bpe_49k.json"
CACHE_ENTRIES, CACHE_CHARS = 240_000, 64

# The vocabulary's own splitting rule, with Latin-1's letters and numbers written out.
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+")
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-ÿ]*")


class Encoder(dict):
    """Maps a lower-case chunk without blanks to its ids as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        self.older: dict[str, bytes] = {}
        self.whole = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.model = self.whole.model
        by_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = lambda piece: by_bytes.pre_tokenize_str(piece)[0][0]

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.pop(chunk, None)
        if out is None:
            ids = [t.id for p in PIECES.findall(chunk) for t in self.model.tokenize(p if p.isascii() else self.spelled(p))]
            out = np.array(ids, "<u4").tobytes()
        if len(chunk) <= CACHE_CHARS:
            if len(self) >= CACHE_ENTRIES // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text, four bytes each."""
        if "<|" not in text and PLAIN.fullmatch(text):
            return b"".join(map(self.__getitem__, text.lower().split()))
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(vocabulary)
