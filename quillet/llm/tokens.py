"""Token ids of whole texts with a word cache in front of a ``tokenizers`` file.

For a tokenizer whose pre-tokens never cross white space the ids of a text are those of its blank-separated words in a
row, so each distinct word is encoded once and texts are joined from cached bytes. That the file is of this kind
is read from the file; any other, and any text holding a special token, is encoded whole.

A text in Latin-1 letters is lower-cased as a whole before, and commas and full stops at the ends of words are set apart where no two marks
stand together, as neither changes an id of such a tokenizer; so fewer distinct words are met.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np

#: Letters whose lower case and composed form don't depend on what stands around them, then ASCII marks but the apostrophe.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


#: Bytes of a text in Latin-1: lower case, blanks as spaces; and whether each is a mark, that is no letter, number or blank.
_BLANKS = b" \t\n\r\v\f"
_LOWER = bytes(0x20 if b in _BLANKS else ord(chr(b).lower()) for b in range(256))
_MARK = bytes(0x20 if b in _BLANKS or unicodedata.category(chr(b))[0] in "LN" else 0x2E for b in range(256))


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: visible Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Words(dict):
    """Ids of words, made where missing; when full, its words become the older generation, from which those met again return."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        super().__init__({"": b""})
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self.make(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
                self[""] = b""
            self[word] = found
        return found


class Encoder:
    """``encode(text)``: the ids of a text as little-endian bytes of ``dtype``."""

    def __init__(self, path: str, special: bool = True, most: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0].get("behavior") == "Removed" and splits[0].get("invert") is True
        # a letter run and a run of marks are two pre-tokens here, so letters go to the model directly
        self.direct = self.by_word and splits[1].get("type") == "ByteLevel" and not spec["model"].get("dropout")
        self.special = [t["content"] for t in spec.get("added_tokens", [])] if special else []
        self.letters = str.maketrans({chr(b): c for b, c in _byte_letters().items()})
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.model = self.tokenizer.model.tokenize
        self.words = _Words(self._word, most)

    def _ids(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _model(self, token: str) -> bytes:
        shown = token if token.isascii() else token.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model(shown)]).tobytes()

    def _word(self, word: str) -> bytes:
        """The ids of a word that the cache lacks."""
        if self.direct and word.isascii() and word.isalpha() and word.islower():
            return array(self.code, [t.id for t in self.model(word)]).tobytes()
        parts = _PLAIN(word) if self.direct else None
        if parts is None:
            return self._ids(word)
        core, marks = parts.groups()
        low = core.lower()
        found = self._model(low) if low == word else self.words[low]
        return found + self.words[marks] if marks else found

    def encode(self, text: str) -> bytes:
        if not self.by_word:
            return self._ids(text)
        if "<" not in text:
            try:
                plain = text.encode("latin-1")
            except UnicodeEncodeError:
                plain = None
            if self.direct and plain is not None:
                low = plain.translate(_LOWER)
                if b".." not in plain.translate(_MARK):
                    low = low.replace(b", ", b" , ").replace(b". ", b" . ")
                return b"".join(map(self.words.__getitem__, low.decode("latin-1").split(" ")))
        elif any(s in text for s in self.special):
            return self._ids(text)
        for blank in "\n\t\r\v\f":
            if blank in text:
                text = text.replace(blank, " ")
        return b"".join(map(self.words.__getitem__, text.split(" ")))


_encoders: dict[tuple, Encoder] = {}


def encoder(path: str, special: bool = True, most: int = 200_000) -> Encoder:
    """One encoder a process for each file; ``most`` words a generation of its cache, which changes speed and memory but no id."""
    key = (path, special, most)
    if key not in _encoders:
        _encoders[key] = Encoder(path, special, most)
    return _encoders[key]
