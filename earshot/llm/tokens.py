"""Ids of whole texts from the vocabulary files of public tokenizers, with a cache per worker.

A text is cut where the tokenizer cuts it anyway, at white space; each distinct piece is encoded by the library once per
worker (as long as it stays in the bounded cache), and a text's ids are its pieces' ids one after the other. That gives
the ids of the whole text for two kinds of files:

* byte-level files ("byte_level"): before a single space or newline between two characters that are no white space,
  the pattern always starts a new pre-token. Texts with other white space, or with "<|", are encoded whole.
* files with word ends ("word_end"): white space is dropped, nothing reaches across a space or a newline.

A new piece of Latin letters (up to U+024F) is split by the file's pattern and its pre-tokens go to the library's model;
any other piece goes through the library's whole pipeline.
"""

from __future__ import annotations

import gc
import os

import numpy as np

#: The patterns of the vocabulary files.
PATTERNS = {
    "byte_level": r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    "word_end": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",
}
#: White space but for the space and the newline; a search for one character is faster than a pattern's.
_GAPS = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_LATIN, _STOPS = "\u024f", tuple(".,!?;:")
#: Pieces longer than this aren't kept in the cache.
_LONG = 64


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones themselves, others from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = (b for b in range(256) if b not in own)
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _irregular(text: str) -> bool:
    """White space that isn't a single space or newline between words, or what may be a special string."""
    if "  " in text or " \n" in text or "\n " in text or "\n\n\n" in text or "<|" in text or "\0" in text:
        return True
    return text[0] in " \n" or text[-1] == " " or text.endswith("\n\n") or any(c in text for c in _GAPS)


class _Cache(dict):
    """Learns what it is asked for and doesn't hold, but keeps no long piece."""

    def __init__(self, learn, older: dict[str, bytes]):
        super().__init__()
        self.learn, self.older = learn, older

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.learn(key)
        if len(key) <= _LONG:
            self[key] = ids
        return ids


class PieceEncoder:
    """``most``: pieces in each of two generations of the cache; what the older one is asked for moves to the newer."""

    def __init__(self, path: str, kind: str, most: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker on each core
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind, self.most = kind, most
        self.split = regex.compile(PATTERNS[kind]).findall
        self.model, self.lower, self.letters = self.tokenizer.model, kind == "word_end", _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.coded = [x.tobytes() for x in np.arange(self.tokenizer.get_vocab_size(), dtype=self.dtype)]
        self.known = _Cache(self._ids, {})

    def pieces(self, text: str) -> list[str]:
        """Keys of the cache. Byte-level: "\\0" before what begins the text, a space left out before other words."""
        if self.kind == "word_end":
            return text.replace("\n", " ").split(" ")
        if not text:
            return []
        if _irregular(text):
            return ["\0" + text]
        keys = text.replace("\n", " \n").split(" ")
        keys[0] = "\0" + keys[0]
        return keys

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _token(self, word: str, space: str = "") -> bytes:
        """Of one pre-token, or of the space before it with it. As a piece of its own it has the same ids, so it shares
        the pieces' cache: under the key that this piece has, or (beyond Latin letters, after lower-casing) one that none has."""
        key = word if space or self.lower else "\0" + word
        if not (word.isascii() or max(word) <= _LATIN):
            key = " " + key
        ids = self.known.get(key)
        if ids is None:
            ids = self.known.older.get(key)
            if ids is None:
                if word.isascii() and word.isalpha():
                    letters = self.letters[0x20] + word if space else word
                else:
                    letters = (space + word).encode().decode("latin-1").translate(self.letters)
                ids = b"".join([self.coded[x.id] for x in self.model.tokenize(letters)])
            self.known[key] = ids
        return ids

    def _ids(self, key: str) -> bytes:
        space = ""
        if self.kind == "byte_level":
            if key[:1] == "\0":
                key = key[1:]
            elif key[:1] != "\n":
                space = " "
        if len(key) > _LONG or "<|" in key or not (key.isascii() or max(key) <= _LATIN):
            return self._whole(space + key)
        if self.lower and not key.islower():  # up to U+024F the normal form changes nothing
            key = key.lower()
        if key.isalpha():
            return self._token(key, space)
        if key[-1:] in _STOPS and key[:-1].isalpha():
            return self._token(key[:-1], space) + self._token(key[-1])
        return b"".join([self._token(t) for t in self.split(space + key)])

    def encode(self, texts: list[str]):
        """Yields the ids of each text as an array of uint32."""
        for text in texts:
            yield np.frombuffer(b"".join(map(self.known.__getitem__, self.pieces(text))), self.dtype).astype(np.uint32)
            if len(self.known) > self.most:
                self.known.older = {}  # the one before it goes
                self.known = _Cache(self._ids, self.known)


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def encoder(path: str, kind: str, most: int = 400_000) -> PieceEncoder:
    """One per worker process: a worker keeps what it has learnt from one task to the next."""
    if (path, kind) not in _ENCODERS or _ENCODERS[path, kind].most != most:
        _ENCODERS.clear()
        gc.freeze()
        gc.set_threshold(200_000)  # few cycles arise here, and each full collection would walk the cache
        _ENCODERS[path, kind] = PieceEncoder(path, kind, most)
    return _ENCODERS[path, kind]
