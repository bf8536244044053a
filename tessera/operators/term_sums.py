"""Scoring for many queries inside a task: large shards, products of matrices for frequent terms, sums for all others.

A shard gathers the chunks of a task until they have ``POSTINGS`` postings of the queries'
terms. Frequent terms are rows of a matrix over the shard's chunks. Queries are taken in
blocks of those that share frequent terms: one product in single precision gives what these terms bring to every
chunk and query of a block. The postings of all other terms are added up query by query. Chunks that reach the
score that they must reach, but for what single precision may be off by, get the frequent terms' part anew in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.operators.posting_blocks import EQUAL, Best, Questions, identifiers

#: Postings of a shard.
POSTINGS = 6_000_000
#: The first shard of a task that no scores bound is so many times smaller, the next four times its size.
FIRST = 64
#: Terms in more than one of so many chunks of a shard are rows of the matrix, while that takes so many bytes; others are added up by their postings.
FREQUENT = 16
MATRIX_BYTES = 192_000_000
#: Sums that a block of queries takes at once.
BLOCK_SUMS = 4_000_000
#: Groups of queries that are told apart by their frequent terms, and rounds that move queries between them.
GROUPS, ROUNDS = 12, 6
#: What a sum of single precision may be off by for each addend, as a share of the largest possible sum.
SINGLE = 1.2e-7


def spans(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The places of all ranges, one range after another."""
    size = end - start
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def alike(questions: Questions) -> np.ndarray:
    """The queries in an order in which those that share frequent terms are neighbours; within a group, by their number.

    A few rounds of spherical k-means. Any order gives the same scores; this one makes products narrow.
    """
    q, query = questions, np.repeat(np.arange(len(questions.ids)), np.diff(questions.start))
    often = np.flatnonzero((q.weight > 0) & (q.weight < q.count * np.log(FREQUENT)))
    used, at = np.unique(q.term[often], return_inverse=True)
    many, group = np.bincount(query[often], minlength=len(q.ids)), np.zeros(len(q.ids), np.int64)
    if len(used) and len(q.ids) > GROUPS:
        full = np.flatnonzero(many >= np.median(many))
        lengths = np.sqrt(np.maximum(1, many))
        group[:] = -1
        group[full[np.linspace(0, len(full) - 1, GROUPS).astype(np.int64)]] = np.arange(GROUPS)  # others join in the first round
        for _ in range(ROUNDS):
            own = group[query[often]]
            centre = np.bincount(own[own >= 0] * len(used) + at[own >= 0], 1 / lengths[query[often]][own >= 0], GROUPS * len(used)).reshape(GROUPS, -1)
            centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-9)
            near = np.stack([np.bincount(query[often], c[at], len(q.ids)) for c in centre])
            group = near.argmax(axis=0)
    return np.lexsort((many, group))


class Sums(Best):
    """``Best`` over large shards. ``need`` may hold scores that k chunks of each query are known to reach."""

    def __init__(self, questions: Questions, k: int, need: np.ndarray | None = None) -> None:
        super().__init__(questions, k)
        if need is not None:
            self.need = need.copy()
        self.terms = pa.array(questions.terms, pa.string())
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.ids: list[np.ndarray] = []
        self.rows_held = self.postings_held = 0
        self.limit = POSTINGS if need is not None else POSTINGS // FIRST
        #: Postings of the queries' terms that shards held, and how many were added up one by one.
        self.held = self.added = 0
        self.order = alike(questions)

    def take(self, ids: pa.Array, tokens: pa.ListArray) -> None:
        lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = pc.index_in(tokens.flatten(), value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        row = np.repeat(np.arange(len(lengths)), lengths)[number >= 0]
        key, tf = np.unique(number[number >= 0] * len(lengths) + row, return_counts=True)
        term, row = np.divmod(key, max(1, len(lengths)))
        self.parts.append((term.astype(np.int32), (row + self.rows_held).astype(np.int32), self.q.gain(tf.astype(np.float64), lengths[row])))
        self.ids.append(identifiers(ids))
        self.rows_held += len(lengths)
        self.postings_held += len(key)
        if self.postings_held >= self.limit:
            self.finish()
            self.limit = min(POSTINGS, 4 * self.limit)

    def finish(self) -> None:
        """Score what was gathered."""
        if self.postings_held:
            term, rows, gains = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            self.parts.clear()
            order = np.argsort(term, kind="stable")  # rows of a term keep their order
            term, rows, gains = term[order], rows[order], gains[order]
            start = np.searchsorted(term, np.arange(len(self.terms) + 1))
            self._score(np.concatenate(self.ids), rows, gains, start)
        self.parts, self.ids, self.rows_held, self.postings_held = [], [], 0, 0

    @staticmethod
    def _frequent(chunks: int, rows: np.ndarray, gains: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each term its row of the matrix or -1, and the matrix (frequent term, chunk) of gains."""
        df = np.diff(start)
        found = np.flatnonzero(df * FREQUENT > chunks)
        found = found[np.argsort(-df[found], kind="stable")][: MATRIX_BYTES // (12 * max(1, chunks))]  # in both precisions
        slot, matrix = np.full(len(df), -1), np.zeros((len(found), chunks))
        slot[found] = np.arange(len(found))
        for place, term in enumerate(found.tolist()):
            own = slice(start[term], start[term + 1])
            matrix[place, rows[own]] = gains[own]
        return slot, matrix

    def _score(self, ids: np.ndarray, rows: np.ndarray, gains: np.ndarray, start: np.ndarray) -> None:
        q, found, n = self.q, [], len(ids)
        df, rows = np.diff(start), rows.astype(np.int64)
        top = np.zeros(len(df))
        top[df > 0] = np.maximum.reduceat(gains, start[:-1][df > 0])
        reach = np.add.reduceat(q.weight * top[q.term], q.start[:-1])
        off = reach * SINGLE * (np.diff(q.start) + 8)
        slot, matrix = self._frequent(n, rows, gains, start)
        single, size = matrix.astype(np.float32), max(1, BLOCK_SUMS // n)
        asked = self.order[((reach > 0) & (reach >= self.need - EQUAL))[self.order]]
        for some in (asked[low : low + size] for low in range(0, len(asked), size)):
            places, owner = spans(q.start[some], q.start[some + 1]), np.repeat(np.arange(len(some)), q.start[some + 1] - q.start[some])
            places, owner = places[df[q.term[places]] > 0], owner[df[q.term[places]] > 0]
            often = slot[q.term[places]] >= 0
            used, at = np.unique(slot[q.term[places[often]]], return_inverse=True)
            wanted = np.zeros((len(some), len(used)))
            wanted[owner[often], at] = q.weight[places[often]]
            sums = wanted.astype(np.float32) @ single[used]
            self.held += int(df[q.term[places]].sum())
            places, owner = places[~often], owner[~often]
            weight, counts = q.weight[places], df[q.term[places]]
            self.added += int(counts.sum())
            begin, end = start[q.term[places]].tolist(), start[q.term[places] + 1].tolist()
            cuts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(some)))]).tolist()
            for j, i in enumerate(some.tolist()):
                a, b, line, part = cuts[j], cuts[j + 1], sums[j], None
                if a < b:
                    own = np.concatenate([rows[x:y] for x, y in zip(begin[a:b], end[a:b], strict=True)])
                    gain = np.concatenate([gains[x:y] for x, y in zip(begin[a:b], end[a:b], strict=True)])
                    gain *= np.repeat(weight[a:b], counts[a:b])
                    part = np.bincount(own, gain, n)
                    line += part.astype(np.float32)  # many times faster than a sum of mixed precision
                need = self.need[i] - EQUAL
                least = need - off[i]
                if least == -np.inf and n > self.k:
                    least = float(np.partition(line, -self.k)[-self.k]) - 2 * off[i] - EQUAL
                seen = np.flatnonzero(line >= np.float32(max(least, 1e-30)))
                if len(seen):
                    mine = np.flatnonzero(wanted[j])
                    scores = wanted[j, mine] @ matrix[used[mine][:, None], seen] if len(mine) else np.zeros(len(seen))
                    if part is not None:
                        scores += part[seen]
                    seen, scores = self._chosen(ids, seen, scores, need)
                    found.append((np.full(len(seen), i), seen, scores))
        if found:
            query, seen, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            self._keep((query, ids[seen], scores))

    def _chosen(self, ids: np.ndarray, seen: np.ndarray, scores: np.ndarray, need: float) -> tuple[np.ndarray, np.ndarray]:
        """The k best that reach ``need``, ties to the smaller id."""
        keep = scores >= need
        seen, scores = seen[keep], scores[keep]
        if len(seen) > self.k:
            keep = scores >= np.partition(scores, -self.k)[-self.k] - EQUAL
            seen, scores = seen[keep], scores[keep]
        if len(seen) > self.k:  # many equal ones
            keep = np.lexsort((ids[seen], -np.round(scores, 9)))[: self.k]
            seen, scores = seen[keep], scores[keep]
        return seen, scores
