"""Vector bin packing of token sequences by the dot-product heuristic.

Each example has a vector of demands: tokens, one segment, and tokens that bear
loss. A sequence is opened, and of all waiting examples that fit into what is
left of it, the one with the largest dot product of its demand and the room left
(both as shares of the limits) goes in next. Where cutting is allowed, the last
gap is filled with the front of the best example that does not fit, whose rest
waits on. Examples longer than a sequence fill whole sequences first.

Work is streamed within a partition, with a bounded pool of waiting examples and
no shuffle; a sequence's number has the partition in its high bits, so a retried
task numbers its sequences alike. A sequence that is not full, by its number of
segments or at a partition's end, is cut into sequences whose lengths are powers of
two, which need no padding.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each for itself; a null document id is kept as null; a very long text is cut
over as many sequences as it needs; of equal products the example that stands first in
the pool is taken; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import encoder, trim

TOKENS = 4096
SEGMENTS = 512
#: Loss-bearing tokens of a sequence at most. Where nearly all tokens bear loss, a lower limit
#: breaks sequences: with 4,032 a quarter of the tokens of texts lay in cut-up ones.
LOSS = TOKENS
#: Examples that wait at most.
POOL = 2048
FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


class Packer:
    """Collects examples and gives sequences as lists of pieces (example, start, length).

    ``loss_from`` of an example is the position from which its tokens bear loss.
    """

    def __init__(self, tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, cut: bool = True) -> None:
        self.caps, self.cut = np.array([tokens, segments, loss], np.float64), cut
        self.key = np.zeros(2 * POOL, np.int64)
        self.start = np.zeros(2 * POOL, np.int64)
        self.loss_from = np.zeros(2 * POOL, np.int64)
        self.need = np.zeros((2 * POOL, 3))
        self.n = 0

    def add(self, key: int, start: int, end: int, loss_from: int = 0) -> None:
        i = self.n
        if i == len(self.key):
            self.key, self.start, self.loss_from = (np.concatenate([a, np.zeros_like(a)]) for a in (self.key, self.start, self.loss_from))
            self.need = np.concatenate([self.need, np.zeros_like(self.need)])
        self.key[i], self.start[i], self.loss_from[i] = key, start, loss_from
        self.need[i] = end - start, 1, max(0, end - max(start, loss_from))
        self.n += 1

    def _drop(self, i: int) -> None:
        last = self.n - 1
        for a in (self.key, self.start, self.loss_from, self.need):
            a[i] = a[last]
        self.n = last

    def sequence(self) -> list[tuple[int, int, int]]:
        """The next sequence, from what waits."""
        left, pieces = self.caps.copy(), []
        weight = 1 / self.caps**2
        while self.n and left[1] >= 1 and left[0] >= 1:
            need = self.need[: self.n]
            score = need @ (left * weight)
            fits = (need <= left).all(axis=1)
            i = int(np.argmax(np.where(fits, score, -1.0)))
            if fits[i]:
                pieces.append((int(self.key[i]), int(self.start[i]), int(need[i, 0])))
                left -= need[i]
                self._drop(i)
                continue
            if not self.cut:
                break
            i = int(np.argmax(np.minimum(need, left) @ (left * weight)))
            start, bears = int(self.start[i]), int(self.loss_from[i])
            length = int(min(left[0], max(0, bears - start) + left[2], need[i, 0]))
            if length <= 0:
                break
            end = start + int(need[i, 0])
            pieces.append((int(self.key[i]), start, length))
            left -= (length, 1, max(0, start + length - max(start, bears)))
            self.start[i] = start + length
            self.need[i] = end - start - length, 1, max(0, end - max(start + length, bears))
        return pieces


def powers(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A sequence cut into sequences whose lengths are powers of two, largest first."""
    total, out, waiting = sum(p[2] for p in pieces), [], list(reversed(pieces))
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        out.append([])
        while room:
            key, start, length = waiting.pop()
            out[-1].append((key, start, min(length, room)))
            if length > room:
                waiting.append((key, start + room, length - room))
            room -= min(length, room)
    return out


def pack_documents(docs: DataFrame, tokenizer: str, *, style: str = "word", end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", tokens: int = TOKENS, segments: int = SEGMENTS, loss: int = LOSS, loss_from_col: str | None = None) -> DataFrame:
    """Pieces of all ``docs`` in sequences of at most ``tokens``; each id lies in exactly one piece.

    ``loss`` limits the loss-bearing tokens of a sequence; ``loss_from_col`` names the
    position from which a row's ids bear loss. Without it the first of several lines is
    taken for the instruction, and what follows it bears loss.
    """
    limit = min(tokens, loss)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids_of, end = encoder(tokenizer, style).ids, end_id.to_bytes(4, "little")
        base, made, packer, rows = TaskContext.get().partitionId() << 33, 0, Packer(tokens, segments, limit), []
        held: dict[int, list] = {}  # what waits: document id, its ids, tokens still to place, where loss begins

        def place(pieces: list[tuple[int, int, int]]) -> None:
            nonlocal made
            at = 0
            for key, start, length in pieces:
                doc = held[key]
                rows.append((doc[0], start, length, zlib.crc32(doc[1][4 * start : 4 * (start + length)]), len(doc[1]) // 4, base + made, at, max(0, start + length - max(start, doc[3]))))
                at += length
                doc[2] -= length
                if not doc[2]:
                    del held[key]
            made += 1

        def place_whole(pieces: list[tuple[int, int, int]]) -> None:
            for part in [pieces] if sum(p[2] for p in pieces) == tokens else powers(pieces):
                place(part)

        seen = 0
        for batch in batches:
            keys, texts, bears = batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()
            for key, text, loss_from in zip(keys, texts, bears, strict=True):
                text = text.as_py() or ""
                ids = ids_of(text) + end
                if loss_from is None:
                    first, line, _ = text.partition("\n")
                    loss_from = len(ids_of(first)) // 4 if line else 0
                n, start = len(ids) // 4, 0
                held[seen] = [key, ids, n, loss_from]
                while limit >= tokens and n - start >= tokens:
                    place([(seen, start, tokens)])
                    start += tokens
                if start < n:
                    packer.add(seen, start, n, loss_from)
                seen += 1
                if packer.n >= POOL:
                    while packer.n > POOL // 2:
                        place_whole(packer.sequence())
            if rows:
                yield _batch(rows)
                rows.clear()
        while packer.n:
            place_whole(packer.sequence())
        if rows:
            yield _batch(rows)
        rows.clear()
        trim()

    bears = F.lit(None) if loss_from_col is None else F.coalesce(F.col(loss_from_col), F.lit(0))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), bears.cast("long").alias("loss_from")).mapInArrow(pack, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=NAMES)
