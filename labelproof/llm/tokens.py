"""Token ids of whole texts by the tokenizers library, with a bounded memory of pieces.

The library's cost is per character of input, while words repeat. A text is therefore cut at
white space, which no token of this vocabulary crosses, and every different piece is encoded
once while it is remembered. Pieces of plain Latin letters, digits and ASCII signs go to the
library's model directly, without its normalizers, which do nothing to them but lower case;
all others, and everything that may hold an added token, go through the whole library.
"""

from __future__ import annotations

import json
import re
from struct import pack

# The word splitter of word_bpe_49k.json, for texts of the characters in SIMPLE only.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
UNITS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+"
)
# Characters that Python's split takes for white space and the library doesn't.
UNSURE = "\x1c\x1d\x1e\x1f"


class Recent(dict):
    """Bounded memory of a function of a string, in two generations.

    When the younger half is full it becomes the older one; an entry found there moves back.
    Strings in steady use stay, and at most `limit` entries are held.
    """

    def __init__(self, compute, limit: int):
        self.compute, self.half, self.older = compute, max(1, limit // 2), {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Pieces:
    """Encoder and decoder of one vocabulary file. Ids are packed as 32-bit little-endian integers."""

    def __init__(self, path: str, limit: int = 250_000, units: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as source:
            described = json.load(source)
        self.added = [t["content"] for t in described["added_tokens"]]
        # The short way holds for this word splitter and these normalizers only.
        splitter = json.dumps(described["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
        self.known = "[^\\s\\p{L}\\p{N}]+" in splitter and [
            n["type"] for n in (described["normalizer"] or {}).get("normalizers", [])
        ] == ["NFC", "Replace", "Lowercase"]
        self.plain_decoder = described["decoder"] is None
        self.names = [self.tokenizer.id_to_token(i) for i in range(self.tokenizer.get_vocab_size())]
        self.pieces, self.units = Recent(self._piece, limit), Recent(self._unit, units)

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return pack(f"<{len(ids)}I", *ids)

    def _unit(self, unit: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(_bytes_as_text(unit))]
        return pack(f"<{len(ids)}I", *ids)

    def _piece(self, piece: str) -> bytes:
        low = piece.lower()
        if piece.isascii():
            if piece.isalpha():
                return self.units[low]
            if piece[:-1].isalpha():
                return self.units[low[:-1]] + self.units[low[-1]]
            if "|" in piece and any(t in piece for t in self.added):
                return self.whole(piece)
        elif not SIMPLE.fullmatch(piece) or "|" in piece and any(t in piece for t in self.added):
            return self.whole(piece)
        return b"".join(map(self.units.__getitem__, UNITS.findall(low)))

    def encode(self, text: str) -> bytes:
        """The packed ids of a whole text."""
        if not self.known or any(c in text for c in UNSURE):
            return self.whole(text)
        return b"".join(map(self.pieces.__getitem__, text.split()))

    def decode(self, ids: list[int]) -> str:
        """What the library's decode(ids, skip_special_tokens=False) gives."""
        if self.plain_decoder:
            return " ".join(map(self.names.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


# Byte-level vocabularies spell a byte as the character of its number, or, where that one is
# blank or a control character, as the next free one from 256 on.
_BLANK = [*range(33), *range(127, 161), 173]
_SPELT = {byte: 256 + i for i, byte in enumerate(_BLANK)}


def _bytes_as_text(unit: str) -> str:
    """The unit in the alphabet in which the vocabulary spells bytes."""
    return unit.encode().decode("latin-1").translate(_SPELT)


_KEPT: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The encoder of this worker process for one vocabulary file."""
    if path not in _KEPT:
        _KEPT[path] = Pieces(path)
    return _KEPT[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
