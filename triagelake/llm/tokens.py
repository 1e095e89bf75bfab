"""Whole-text tokenisation with the tokenizers library behind bounded caches.

A tokenizer's pre-tokeniser never joins characters across a single space that
stands between two other characters that are no white space. A text is cut there
into space-led pieces, and each piece is encoded once per worker. Pieces that
miss are cut further by the pre-tokeniser's own pattern, so that words that
differ in the punctuation behind them share one encoding.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import regex
import tokenizers

CACHE = 700_000        # pieces a worker remembers
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_OTHER_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
_TOUCHING = ["  ", " \n", "\n ", "\n\n"]
# The pre-tokenisation patterns of the two public vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def pieces(text: str) -> list[list[str]]:
    """Lines of pieces: the text cut at single line feeds and spaces between other characters.

    All pieces of a line but the first lost the space before them. A text with
    neighbouring white space is one line, cut at its inner single spaces only.
    """
    if any(t in text for t in _TOUCHING) or any(
            c + t in text or t + c in text for c in _OTHER_SPACES if c in text for t in " \n"):
        return [_INNER_SPACE.split(text)]
    return [line.split(" ") for line in text.split("\n")]


class Generations:
    """A dict of bounded size: when the young half is full, the old half goes."""

    def __init__(self, limit: int):
        self.limit, self.young, self.old = max(1, limit // 2), {}, {}

    def get(self, key):
        v = self.young.get(key)
        if v is None:
            v = self.old.get(key)
            if v is not None:
                self.put(key, v)
        return v

    def put(self, key, value) -> None:
        if len(self.young) >= self.limit:
            self.old, self.young = self.young, {}
        self.young[key] = value


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: visible Latin-1 ones for themselves."""
    visible = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """ids of whole texts; `path` is a tokenizers file, `cache` the number of cached pieces."""

    def __init__(self, path: str, cache: int = CACHE):
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = str(self.tokenizer.pre_tokenizer).replace("\\\\", "\\")
        self.lower = self.tokenizer.normalizer is not None
        if self.lower and WORD_PATTERN in kind and "Lowercase" in str(self.tokenizer.normalizer):
            self.pattern = regex.compile(WORD_PATTERN)
        elif not self.lower and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind:
            self.pattern = regex.compile(BYTE_PATTERN)
        else:
            self.pattern = None
        self._line_feed = self._library("\n")
        self._marks = {m: self._library(m) for m in ".,;:!?"} if self.pattern else {}
        self._agreed: dict[str, bool] = {}
        # led: pieces after a space, kept without it; first: those at the start of a text.
        self.led, self.first = Generations(cache), Generations(1 + cache // 4)

    def _pre_token(self, word: str) -> bytes:
        if not word.isascii() or " " in word or not word.isprintable():
            word = word.encode().decode("latin-1").translate(self.letters)
        return array(self.dtype.char, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _same(self, c: str) -> bool:
        """Whether the library and this module put a character beyond ASCII into the same class.

        Their Unicode tables are of different versions. A vocabulary in lower case also
        decomposes letters, so only Latin-1 ones, which it keeps, are the same there.
        """
        known = self._agreed.get(c)
        if known is None:
            split = self.tokenizer.pre_tokenizer.pre_tokenize_str
            known = not (self.lower and c >= "\u0100") and all(
                (len(split(x + c + x)) == 1) == (len(self.pattern.findall(x + c + x)) == 1) for x in "a1.") and (
                c.isalpha() == (len(split("a" + c + "a")) == 1))
            self._agreed[c] = known
        return known

    def _plain(self, piece: str) -> bool:
        """Whether a piece may be cut here as the library would cut it."""
        return piece.isascii() or all(self._same(c) for c in piece if c > "\x7f")

    def _library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _piece(self, piece: str, led: bool) -> bytes:
        """ids of one piece: by its pre-tokens where the pattern is known, else by the library's whole path."""
        if self.pattern is None or not self._plain(piece) or "<" in piece and any(s in piece for s in self.special):
            return self._library(" " + piece if led else piece)
        mark = self._marks.get(piece[-1:])
        if mark and piece[:-1].isalpha():
            return self.lookup(piece[:-1], led) + mark
        if self.lower:
            small = piece.lower()
            if small.isalpha():
                return self._pre_token(small) if small == piece else self.lookup(small)
            parts = self.pattern.findall(small)
            return b"".join([self.lookup(w) for w in parts]) if parts != [piece] else self._pre_token(piece)
        if piece.isalpha():
            return self._pre_token(" " + piece if led else piece)
        whole = " " + piece if led else piece
        parts = self.pattern.findall(whole)
        if len(parts) < 2:
            return self._pre_token(whole) if whole else b""
        return b"".join([self.lookup(w[1:]) if w[0] == " " else self.lookup(w, led=False) for w in parts])

    def lookup(self, piece: str, led: bool = True) -> bytes:
        cache = self.led if led else self.first
        ids = cache.get(piece)
        if ids is None:
            ids = self._piece(piece, led)
            if not (piece[-1:] in self._marks and piece[:-1].isalpha() and self._plain(piece)):
                cache.put(piece, ids)
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """ids of a text, without added special tokens, as little-endian integers of `dtype`."""
        out = []
        for first, *rest in pieces(text):
            known = self.led.young.get
            ids = list(map(known, rest))
            if None in ids:
                for i, v in enumerate(ids):
                    if v is None:
                        p = rest[i]
                        mark = self._marks.get(p[-1:])
                        v = mark and known(p[:-1])      # a word and a mark behind it
                        ids[i] = v + mark if v and p[:-1].isalpha() and self._plain(p) else self.lookup(p)
            out.append(self.lookup(first, led=False) + b"".join(ids))
        return self._line_feed.join(out)

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), self.dtype)


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One encoder for all tasks of a Python worker.

    Task functions travel by value and bring their own copy of this module, so
    the encoders are kept in a module that every worker has.
    """
    kept = tokenizers.__dict__.setdefault("_kept_encoders", {})
    if (path, cache) not in kept:
        kept[path, cache] = Encoder(path, cache)
    return kept[path, cache]
