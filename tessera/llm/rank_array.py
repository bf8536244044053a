"""Byte-pair encoding and decoding with a contiguous array of ranks for each word.

A word is one array of parts between boundaries, each the id of its token, and beside it one
array of the ranks of neighbours. The smallest rank is found by a scan, the boundary
between the two parts is deleted, and the ranks of the new part with its neighbours are
looked up again, until no neighbours merge. Words of more than ``SHORT`` characters keep the same parts in
linked lists and take the smallest rank from a heap, so that a long run without a space
costs n log n; the results are the same.

Words come by the file's own rules. In texts of ASCII and Latin letters they are cut by
one regular expression; elsewhere texts are cut at ASCII white space, which no rule joins,
and words with any other character go through the library's normaliser and
pre-tokenizer, which know their Unicode version. Merging is never left to the library.
Frequent words are merged once for each Python worker.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated
rows and equal or null document ids are encoded each for itself; very long texts and words
are encoded whole; an empty table gives no rows; of equal ranks the first in the word
merges first; other columns are not looked at. Strings of special tokens in a text are
ordinary text, unless ``special_tokens`` is set: then each is its own id, as in the
library without ``encode_special_tokens``.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import LETTERS, UNSURE, visible_bytes

#: Words of more characters take the heap.
SHORT = 128
#: Words to keep, about 200 bytes each.
CACHE = 450_000
#: Longer words are seldom met twice.
CACHED_LENGTH = 64
#: Stands for the end of a word in the strings of tokens here; no visible byte is a line feed.
END = "\n"
#: Words of sure texts as written; small letters may lie outside the range, so they come after the cut.
_UNITS = re.compile(rf"'[sStTmMdD]|'[rRvV][eE]|'[lL][lL]|[{LETTERS}]+|[0-9]|[^ \t\n\x0b\x0c\r{LETTERS}0-9]+").findall
#: Longer pieces of sure texts without an apostrophe, each of whole units.
_PIECES = re.compile(rf"[{LETTERS}]+|[^ \t\n\x0b\x0c\r{LETTERS}]+").findall
_WORDS = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall


class RankArray:
    """The merges of a tokenizer file of byte-level words with an end-of-word suffix."""

    def __init__(self, path: str, special_tokens: bool = False) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as source:
            described = json.load(source)
        model = described["model"]
        suffix = model.get("end_of_word_suffix") or ""
        if model["type"] != "BPE" or not suffix or described["decoder"] is not None:
            raise ValueError("a BPE file with an end-of-word suffix and without a decoder is needed")

        def own(token: str) -> str:
            return token.removesuffix(suffix) + END if token.endswith(suffix) and token != suffix else token

        id_of = {own(token): i for token, i in model["vocab"].items()}
        self.size = max(id_of.values()) + 1
        self.part_of = {c: i for c, i in id_of.items() if len(c) == 1}
        self.end_of = {c[0]: i for c, i in id_of.items() if len(c) == 2 and c[1] == END}
        #: A pair of neighbours is left * size + right; its rank, and what a rank gives.
        self.rank_of: dict[int, int] = {}
        self.made: list[int] = []
        for left, right in (pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]):
            self.rank_of[id_of[left] * self.size + id_of[own(right)]] = len(self.made)
            self.made.append(id_of[left + own(right)])
        self.none = len(self.made)
        self.token_of = {i: token.encode() for token, i in model["vocab"].items()} | {t["id"]: t["content"].encode() for t in described["added_tokens"]}
        specials = {t["content"]: t["id"] for t in described["added_tokens"]} if special_tokens else {}
        self.specials = {text: struct.pack("<I", i) for text, i in specials.items()}
        self.cut_specials = re.compile("(" + "|".join(map(re.escape, sorted(specials, key=len, reverse=True))) + ")").split if specials else None
        library = Tokenizer.from_file(path)
        self.normalise, self.split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.visible = str.maketrans({chr(b): c for b, c in visible_bytes().items()})
        self.known: dict[str, bytes] = {}

    def merged(self, word: str) -> list[int]:
        """Ids of one word of visible bytes, the last of which ends it."""
        parts = [self.part_of[c] for c in word]
        parts[-1] = self.end_of[word[-1]]
        if len(word) > SHORT:
            return self._merged_long(parts)
        size, none, rank_of, made = self.size, self.none, self.rank_of.get, self.made
        ranks = [rank_of(a * size + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < none:
            i = ranks.index(least)
            parts[i] = part = made[least]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank_of(parts[i - 1] * size + part, none)
            if i < len(ranks):
                ranks[i] = rank_of(part * size + parts[i + 1], none)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        """The same by linked neighbours and a heap of (rank, place, its part, the next part)."""
        size, none, rank_of, heap = self.size, self.none, self.rank_of.get, []
        after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))

        def push(a: int) -> None:
            if a >= 0 and (b := after[a]) >= 0 and (rank := rank_of(parts[a] * size + parts[b], none)) < none:
                heapq.heappush(heap, (rank, a, parts[a], parts[b]))

        for a in range(len(parts)):
            push(a)
        while heap:
            rank, a, left, right = heapq.heappop(heap)
            b = after[a]
            if parts[a] != left or b < 0 or parts[b] != right:
                continue  # one of the two parts has changed since
            parts[a], parts[b], after[a] = self.made[rank], -1, after[b]
            if after[a] >= 0:
                before[after[a]] = a
            push(a)
            push(before[a])
        return [part for part in parts if part >= 0]

    def _piece(self, piece: str) -> bytes:
        if UNSURE(piece):
            units = [unit for unit, _ in self.split(self.normalise(piece))]
        else:
            units = [unit if unit.isascii() and unit.isprintable() else unit.encode().decode("latin-1").translate(self.visible) for unit in map(str.lower, _UNITS(piece))]
        ids = [i for unit in units for i in self.merged(unit)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, piece: str) -> bytes:
        ids = self._piece(piece)
        if len(self.known) < CACHE and len(piece) <= CACHED_LENGTH:
            self.known[piece] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        pieces = _WORDS(text) if "'" in text or UNSURE(text) else _PIECES(text)
        known, learn = self.known.get, self._learn
        return b"".join([learn(p) if (ids := known(p)) is None else ids for p in pieces])

    def encode(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a whole text."""
        if not text:
            return b""
        if self.cut_specials is None:
            return self._plain(text)
        return b"".join(self.specials[part] if part in self.specials else self._plain(part) for part in self.cut_specials(text) if part)

    def decode(self, ids: bytes | None) -> str:
        """The tokens of the ids with a space between, as the library decodes where the file names no decoder; unknown ids give nothing."""
        if not ids:
            return ""
        token_of = self.token_of.get
        return b" ".join([t for i in numbers(ids) if (t := token_of(i)) is not None]).decode()


def numbers(ids: bytes) -> array:
    out = array("I")
    out.frombytes(ids)
    if struct.pack("=I", 1) != struct.pack("<I", 1):
        out.byteswap()
    return out


_LOADED: dict[tuple[str, bool], RankArray] = {}


def rank_array(path: str, special_tokens: bool = False) -> RankArray:
    """One table of merges for each Python worker, so that its words serve many tasks."""
    if (path, special_tokens) not in _LOADED:
        _LOADED[path, special_tokens] = RankArray(path, special_tokens)
    return _LOADED[path, special_tokens]


def encode_documents(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", special_tokens: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids): of every text its ids, as little-endian unsigned 32-bit integers in one binary."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rank_array(tokenizer, special_tokens).encode
        for batch in batches:
            ids = [of(text.as_py()) for text in batch.column(1)]
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(encode, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) from what ``encode_documents`` gives."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = rank_array(tokenizer).decode
        for batch in batches:
            texts = pa.array([of(ids.as_py()) for ids in batch.column(2)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(decode, "doc_id long, n_tokens long, ids binary, decoded string")
