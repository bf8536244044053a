"""Token ids of whole texts by a public tokenizer file, with a cache of word pieces.

Both tokenizer families in use split a text before they merge pairs, and never
merge across the end of a word. A text is therefore cut where such a split is
certain, each distinct piece is encoded by the tokenizers library, and a document is
the concatenation of its pieces' ids. A piece that is sure to be one unit of the
split goes straight to the library's merge model, others through all its steps.
Texts with characters on which the two regular-expression engines may differ are cut
more coarsely or encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

#: Pieces to keep, about 200 bytes each; the frequent ones come early, later ones are encoded each time.
CACHE = 450_000
#: Letters of the range in which the finer cuts below are certain. U+0130 is not one of them: in small
#: letters it is two characters, the second of which stands with the signs that follow.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f"
#: A character outside ASCII and those letters, or one that Python alone takes as white space.
UNSURE = re.compile(f"[^\x00-\x1b\x20-\x7f{LETTERS}]").search
#: Characters that Python's ``\\s`` takes as white space and other engines do not.
ODD_SPACE = re.compile("[\x1c-\x1f]").search
_FINE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+").findall
_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+").findall
_FINE_WORDS = re.compile(rf"[{LETTERS}]+|[^ \t\n\x0b\x0c\r{LETTERS}]+").findall
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall


def byte_level_pieces(text: str) -> tuple[list[str] | None, bool]:
    """Cuts for byte-level BPE, where a word keeps one space before it, and whether each is one unit; None where a cut is unsure."""
    if not UNSURE(text):
        return _FINE(text), True
    return (None, False) if ODD_SPACE(text) else (_COARSE(text), False)


def word_pieces(text: str) -> tuple[list[str] | None, bool]:
    """Cuts for a tokenizer that drops white space and lower-cases; with an apostrophe, whole words."""
    return (_WORDS(text), False) if "'" in text or UNSURE(text) else (_FINE_WORDS(text), True)


def visible_bytes() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next free one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or (161 <= b <= 255 and b != 173)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


STYLES = {"byte_level": byte_level_pieces, "word": word_pieces}


class Encoder:
    """``ids(text)``: little-endian unsigned 32-bit ids of a whole text, as bytes."""

    def __init__(self, path: str, style: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model, self.visible = self.tokenizer.model, visible_bytes()
        self.pieces, self.lower = STYLES[style], style == "word"
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _units(self, units: list[str]) -> list[bytes]:
        """Ids of single units by the merge model."""
        merge, visible, space, out = self.model.tokenize, self.visible, self.visible[32], []
        for unit in units:
            if unit.isascii() and unit.isprintable():
                unit = unit.replace(" ", space)
            else:
                unit = unit.encode().decode("latin-1").translate(visible)
            out.append(array("I", [t.id for t in merge(unit)]).tobytes())
        return out

    def _learn(self, new: list[str], units: bool) -> dict[str, bytes]:
        if not units:
            return dict(zip(new, self._encode(new), strict=True))
        if not self.lower:
            return dict(zip(new, self._units(new), strict=True))
        words, rest = [p for p in new if p.isalpha()], [p for p in new if not p.isalpha()]
        return dict(zip(words, self._units([w.lower() for w in words]), strict=True)) | dict(zip(rest, self._encode(rest), strict=True))

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        pieces, units = self.pieces(text)
        if pieces is None:
            return self._encode([text])[0]
        known = self.known
        new = set(pieces).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, pieces))
        own = self._learn(list(new), units)
        if len(known) + len(own) <= CACHE:
            known.update(own)
            return b"".join(map(known.__getitem__, pieces))
        of = known.get
        return b"".join([own[p] if (ids := of(p)) is None else ids for p in pieces])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, style: str) -> Encoder:
    """One encoder for each Python worker, so that its cache serves many tasks."""
    if (path, style) not in _ENCODERS:
        _ENCODERS[path, style] = Encoder(path, style)
    return _ENCODERS[path, style]


def release() -> None:
    """Give back what this Python worker holds but does not use: encoders of other operators, and freed memory."""
    import gc

    if _ENCODERS:
        _ENCODERS.clear()
        gc.collect()
    trim()


def trim() -> None:
    """Give freed memory back to the machine, so that a worker that waits for its next task holds little."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:  # only this C library keeps freed memory until told
        give_back(0)
