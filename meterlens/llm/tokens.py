"""Token ids of whole texts by the tokenizers library, with word caches for byte-level BPE.

A byte-level BPE never merges across the cuts of its pre-tokenizer, and that
always cuts before a space which a visible character follows.  Texts are cut
there, and every word is encoded once per worker; the caches are bounded.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import regex

#: Words, and other pieces of text, kept in a worker's caches; further ones are encoded each time.
CACHE, PIECES = 600_000, 200_000

#: The pre-tokenizer's pattern (a fixed value of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Marks that may end a word; with no space, letter, digit or apostrophe among them they are one pre-token.
_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")

_VISIBLE = "!-~\u00a1-\u024f"
_CUT = re.compile(f" (?=[{_VISIBLE}])")
_OTHER_SPACE = re.compile(f" (?![{_VISIBLE}])")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, str]:
    """The letter by which byte-level BPE writes each byte: itself if printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b): chr(b if b in plain else next(others)) for b in range(256)}


class WordEncoder(dict):
    """Word (without the space before it) -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        # No word is cut out of a text that holds one of these: the library finds them before it cuts words.
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._pieces: dict[str, bytes] = {}
        self._split = regex.compile(PATTERN).findall
        self._letters = str.maketrans(_byte_letters())
        self._space, self._model = _byte_letters()[" "], self.tokenizer.model
        self._by_words = "ByteLevel" in str(self.tokenizer.pre_tokenizer) and self.tokenizer.normalizer is None

    def _piece(self, piece: str) -> bytes:
        spelt = piece.encode().decode("latin-1").translate(self._letters)
        ids = array("I", [t.id for t in self._model.tokenize(spelt)]).tobytes()
        if len(self._pieces) < PIECES and len(piece) <= 40:
            self._pieces[piece] = ids
        return ids

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _unit(self, text: str) -> bytes:
        if text.isascii() or max(text) < "\u0250":
            known = self._pieces
            return b"".join([known.get(p) or self._piece(p) for p in self._split(text)])
        return self._whole(text)

    def __missing__(self, word: str) -> bytes:
        # Most words are letters and a few marks.  Marks after a letter are a pre-token of their own, whatever stands
        # before that letter, and the words without them alone fill the cache.
        bare = word.rstrip(_MARKS)
        if len(bare) < len(word) and (last := bare[-1:]).isalpha() and last < "\u0250":
            marks = word[len(bare):]
            return self[bare] + (self._pieces.get(marks) or self._piece(marks))
        if word.isalpha() and max(word) < "\u0250":
            spelt = word if word.isascii() else word.encode().decode("latin-1").translate(self._letters)
            ids = array("I", [t.id for t in self._model.tokenize(self._space + spelt)]).tobytes()
        else:
            ids = self._unit(" " + word)
        if len(self) < CACHE and len(word) <= 40:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as the library's ``encode(text, add_special_tokens=False)`` gives them."""
        if not self._by_words or any(added in text for added in self._added):
            return self._whole(text)
        words = text.split(" ") if not _OTHER_SPACE.search(text) else _CUT.split(text)
        return self._unit(words[0]) + b"".join(map(self.__getitem__, words[1:]))


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """The worker's encoder; workers are reused, so its caches last over many tasks."""
    return WordEncoder(path)
