"""Token ids and counts of whole texts through caches of pieces.

A tokenizer of the ``tokenizers`` library never joins text across the places
where its own pattern cuts, so a text's ids are those of its pieces in a row.
Texts of code points below 256 without special-token strings are cut here by
the pattern (classes built from the character database); texts with others are
cut by the library's own pre-tokenizer, and texts with special-token strings go
through the library whole.  The ids of a piece always come from the BPE model of
the vocabulary file.
"""

from __future__ import annotations

import re
import struct
import unicodedata

from tokenizers import Tokenizer

CACHE_ENTRIES = 400_000
CACHED_LENGTH = 48

_LATIN = [chr(c) for c in range(256)]
_CLASS = {k: "".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == k) for k in "LN"}
#: Anything but code points below 256; \x1c-\x1f are white space to Python only.
_OTHER = re.compile("[^\x00-\x1b\x20-\xff]")
_SPLIT_ELSEWHERE = re.compile("[\x1c-\x1f\x85\xa0\u0100-\U0010ffff]")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1
    stands for itself, the others follow from code point 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PieceTokenizer:
    """A vocabulary file with the pattern by which it cuts plain texts."""

    def __init__(self, path: str):
        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = False
        self.model = self.tok.model
        added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})

    def plain(self, text: str) -> bool:
        """Whether the pattern may cut this text here."""
        if self.special is not None and "<|" in text and self.special.search(text):
            return False
        return not _OTHER.search(text)

    def marked(self, text: str) -> bool:
        """Whether the text holds a special-token string."""
        return self.special is not None and "<|" in text and bool(self.special.search(text))

    def cut(self, text: str) -> list[str]:
        """Pieces of a text without special-token strings, by the library's
        pre-tokenizer: slices of the text."""
        out, at = [], 0
        for _, (_, end) in self.tok.pre_tokenizer.pre_tokenize_str(text):
            if end > at:
                out.append(text[at:end])
                at = end
        return out

    def piece_ids(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isalpha()):     # letters of ASCII stand for themselves
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(piece)]

    def encode(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids


class BoundedCache(dict):
    """A cache of at most ``CACHE_ENTRIES`` short keys.  When it is full the
    entries that came first, the frequent ones among them, stay; it starts
    afresh once it has missed several times its size (other texts have come).
    """

    first: dict = {}

    def keep(self, key: str, value):
        if len(key) <= CACHED_LENGTH:
            if len(self) < len(self.first) + CACHE_ENTRIES:
                self[key] = value
            else:
                self.missed = getattr(self, "missed", 0) + 1
                if self.missed > 8 * CACHE_ENTRIES:
                    self.clear()
                    self.update(self.first)
                    self.missed = 0
        return value


class PieceIds(BoundedCache):
    """Piece → its ids as little-endian bytes."""

    def __init__(self, pt: PieceTokenizer):
        super().__init__()
        self.pt = pt

    def __missing__(self, piece: str) -> bytes:
        return self.keep(piece, _packed(self.pt.piece_ids(piece)))


class WordIds(BoundedCache):
    """Word (as the text has it) → its ids as little-endian bytes, for a
    tokenizer that lower-cases and drops white space.  A miss cuts the word
    into pieces, which have a cache of their own.
    """

    def __init__(self, path: str):
        super().__init__()
        self.pt = PieceTokenizer(path)
        self.pieces = PieceIds(self.pt)
        self.cut = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[%s]+|[%s]|[^\\s%s%s]+"
                              % (_CLASS["L"], _CLASS["N"], _CLASS["L"], _CLASS["N"])).findall
        self.split = re.compile("[^ \t\n\r\f\v]+").findall

    def __missing__(self, word: str) -> bytes:
        if self.pt.plain(word):
            low = word.lower()
            ids = self.pieces[low] if low.isalpha() else b"".join(map(self.pieces.__getitem__, self.cut(low)))
        else:
            ids = _packed(self.pt.encode(word))
        return self.keep(word, ids)

    def ids(self, text: str | None) -> bytes:
        """The ids of a whole text, each as four little-endian bytes."""
        if not text:
            return b""
        special = self.pt.special
        if special is not None and "<|" in text and special.search(text):
            return _packed(self.pt.encode(text))
        # Python's split also cuts at \x1c-\x1f and at Unicode spaces
        parts = text.split() if not _SPLIT_ELSEWHERE.search(text) else self.split(text)
        return b"".join(map(self.__getitem__, parts))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class PieceCounts(BoundedCache):
    """Piece → number of ids, for a byte-level tokenizer that keeps white
    space.  ``frequent`` is the fixed first tier; misses are encoded and kept
    beside it."""

    def __init__(self, path: str, frequent: dict[str, int]):
        super().__init__(frequent)
        self.first = frequent
        self.pt = PieceTokenizer(path)
        self.cut = cut_byte_level()

    def __missing__(self, piece: str) -> int:
        return self.keep(piece, len(self.pt.piece_ids(piece)))

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if self.pt.plain(text):
            return sum(map(self.__getitem__, self.cut(text)))
        if self.pt.marked(text):
            return len(self.pt.encode(text))
        return sum(map(self.__getitem__, self.pt.cut(text)))


def cut_byte_level():
    """The cut of plain texts for byte-level BPE."""
    return re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[%s]+| ?[%s]+| ?[^\\s%s%s]+|\\s+(?!\\S)|\\s+"
                      % (_CLASS["L"], _CLASS["N"], _CLASS["L"], _CLASS["N"])).findall
