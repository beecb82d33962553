"""Token ids of a public vocabulary, fast enough for whole corpora.

``byte_bpe_50k`` splits a text before each space that leads a visible character, so
a text's ids are the ids of its space-led words one after another. Words repeat, and
a bounded dictionary keeps the ids of those seen. The same ids come from the
``tokenizers`` file and from the rank file of that vocabulary; the rank file's
library is used for words not in the dictionary because it is faster. Where words repeat too
little for the dictionary to pay, whole texts are encoded; the ids are the same. The tokens
that the ``tokenizers`` file adds are found in a text before all else, as its library does.
"""

from __future__ import annotations

import base64
import json
import re
import zlib

# Entries a dictionary may hold before it is emptied; about 60 MB in a Python worker.
CACHE_WORDS = 200_000
# A word that is not in the dictionary takes the time of about so many words of a whole text.
MISS_COST = 10
# A space followed by white space: the only case in which a space does not start a token.
_ODD = re.compile(r" \s")


def vocabulary_path(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


class BpeIds(dict):
    """Little-endian 32-bit ids of texts. As a dictionary: word to ids of space + word.

    ``added`` names the ``tokenizers`` file whose added tokens stand for themselves in a text.
    """

    def __init__(self, ranks_path: str, added: str | None = None):
        import numpy as np
        import public_tokenizers
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._array = lambda ids: np.array(ids, dtype="<u4").tobytes()
        self._encode = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary
        self._asked, self._whole = 0, False
        self._added: dict[str, bytes] = {}
        if added:
            with open(added, encoding="utf-8") as file:
                tokens = json.load(file)["added_tokens"]
            if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in tokens):
                raise ValueError("added tokens that depend on their neighbours are not read")
            self._added = {t["content"]: self._array([t["id"]]) for t in tokens}
        # The leftmost token counts, of those at one place the longest.
        longest = sorted(self._added, key=lambda t: (-len(t), t))
        self._cut = re.compile("(" + "|".join(map(re.escape, longest)) + ")").split

    def __missing__(self, word: str) -> bytes:
        ids = self._array(self._encode(" " + word))
        self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > CACHE_WORDS:
            self._whole = self._asked < MISS_COST * len(self)
            self._asked = 0
            self.clear()
        if any(token in text for token in self._added):
            parts = self._cut(text)
            return b"".join(self._added.get(p) or self._plain(p) for p in parts if p)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if self._whole or _ODD.search(text):
            return self._array(self._encode(text))
        first, *rest = text.split(" ")
        self._asked += len(rest)
        return self._array(self._encode(first)) + b"".join(map(self.__getitem__, rest))


_loaded: dict[tuple[str, str | None], BpeIds] = {}


def bpe_ids(ranks_path: str, added: str | None = None) -> BpeIds:
    """One encoder per worker process and vocabulary."""
    if (ranks_path, added) not in _loaded:
        _loaded[ranks_path, added] = BpeIds(ranks_path, added)
    return _loaded[ranks_path, added]


def crc_of(ids: bytes) -> int:
    return zlib.crc32(ids)
