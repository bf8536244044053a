"""Scoring of posting blocks inside a task: the k best chunks of every query, no row a pair.

A shard holds a few thousand chunks and, for each term, its postings in blocks, those of
most impact first. A block knows its largest term frequency and its shortest chunk,
which bound every score in it whatever the collection's average length has become. A query
reads blocks by falling bound, until what the unread ones could add is less than its
k-th best score. After that only its candidates count: they are looked up in the terms
that have unread blocks, and the blocks are skipped. So are whole shards whose best blocks
cannot reach that score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Postings of a block.
BLOCK = 512
#: Scores that differ by less are equal.
EQUAL = 1e-8


def identifiers(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers or, of any other type, as text, in an array that sorts as Spark does."""
    return column.to_numpy(zero_copy_only=False) if pa.types.is_integer(column.type) else np.array(column.cast(pa.string()).to_pylist(), dtype=str)


@dataclass
class Questions:
    """Queries as lists of weighted terms; ``weight`` is the query's count of the term times its IDF."""

    ids: np.ndarray
    terms: list[str]
    start: np.ndarray  # of each query's terms, and the end
    term: np.ndarray
    count: np.ndarray
    average: float = 1.0
    k1: float = 1.5
    b: float = 0.75
    weight: np.ndarray = field(default_factory=lambda: np.empty(0))

    def weigh(self, df: np.ndarray, chunks: int, total: int) -> None:
        """Set weights and the average length from the collection's statistics; terms that no chunk has weigh nothing."""
        idf = np.where(df > 0, np.log((chunks - df + 0.5) / (df + 0.5) + 1), 0.0)
        self.weight, self.average = self.count * idf[self.term], total / chunks if chunks and total else 1.0

    def gain(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.average))


@dataclass
class Postings:
    """Blocks of one term in one shard: rows and term frequencies by falling impact, and the bounds of each block."""

    rows: np.ndarray
    tfs: np.ndarray
    top_tf: np.ndarray
    low_length: np.ndarray
    by_row: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def look_up(self, rows: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``rows`` have a posting in this block or a later one, and its term frequency."""
        if self.by_row is None:
            order = np.argsort(self.rows, kind="stable")
            self.by_row = self.rows[order], self.tfs[order], order
        own, tfs, place = self.by_row
        at = np.minimum(np.searchsorted(own, rows), len(own) - 1)
        found = np.flatnonzero((own[at] == rows) & (place[at] >= block * BLOCK))
        return found, tfs[at[found]]


@dataclass
class Shard:
    ids: np.ndarray
    lengths: np.ndarray
    postings: dict[int, Postings]
    alive: np.ndarray | None = None


def ordered(rows: np.ndarray, tfs: np.ndarray, lengths: np.ndarray) -> Postings:
    """Postings of one term by falling impact, as far as it is the same for all collections: tf against length."""
    own = lengths[rows]
    order = np.lexsort((rows, -tfs / (tfs + 0.5 + own / max(1.0, float(lengths.mean())))))
    rows, tfs, own = rows[order], tfs[order], own[order]
    at = np.arange(0, len(rows), BLOCK)
    return Postings(rows, tfs, np.maximum.reduceat(tfs, at), np.minimum.reduceat(own, at))


def shard_of(ids: np.ndarray, tokens: pa.ListArray, terms: pa.Array | None) -> tuple[Shard, pa.Array]:
    """A shard of tokenised chunks and the terms that its postings number: the given ones, or all."""
    lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = tokens.flatten()
    if terms is None:
        coded = flat.dictionary_encode()
        terms, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        number = pc.index_in(flat, value_set=terms).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(lengths)), lengths)
    key, tf = np.unique(number[number >= 0] * len(lengths) + row[number >= 0], return_counts=True)
    term, row = np.divmod(key, max(1, len(lengths)))
    cuts = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(cuts[1:], len(term))[: len(cuts)]  # a shard without any of the terms has no cuts
    found = {int(term[a]): ordered(row[a:b], tf[a:b], lengths) for a, b in zip(cuts, ends, strict=True)}
    return Shard(ids, lengths, found), terms


def combined(parts: list[tuple[Shard, dict[int, str]]]) -> tuple[Shard, dict[str, int]]:
    """One shard of the living chunks of several, and the numbers of its terms."""
    names: dict[str, int] = {}
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    ids, lengths, base = [], [], 0
    for shard, own in parts:
        alive = np.ones(len(shard.ids), bool) if shard.alive is None else shard.alive
        place = np.cumsum(alive) - 1 + base
        for number, p in shard.postings.items():
            keep = alive[p.rows]
            if keep.any():
                held.setdefault(names.setdefault(own[number], len(names)), []).append((place[p.rows[keep]], p.tfs[keep]))
        ids.append(shard.ids[alive])
        lengths.append(shard.lengths[alive])
        base += int(alive.sum())
    whole = np.concatenate(lengths)
    merged = {t: ordered(np.concatenate([r for r, _ in p]), np.concatenate([f for _, f in p]), whole) for t, p in held.items()}
    return Shard(np.concatenate(ids), whole, merged), names


class Best:
    """The k best (query, chunk, score) so far and, for each query, the score that a further chunk must reach."""

    def __init__(self, questions: Questions, k: int) -> None:
        self.q, self.k = questions, k
        self.need = np.full(len(questions.ids), -np.inf)
        self.rows: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        #: Blocks of the queries' terms that shards held, and how many of them were read.
        self.blocks = self.read = 0

    def add(self, shard: Shard) -> None:
        q, found = self.q, []
        bounds: dict[int, np.ndarray] = {}
        for number, p in shard.postings.items():  # no later block of a term is bounded higher than an earlier one
            bounds[number] = np.maximum.accumulate(q.gain(p.top_tf, p.low_length)[::-1])[::-1]
        first = np.zeros(len(q.terms))
        for number, b in bounds.items():
            first[number] = b[0]
        sums = np.concatenate([[0.0], np.cumsum(q.weight * first[q.term])])
        reach = sums[q.start[1:]] - sums[q.start[:-1]]
        count = np.zeros(len(q.terms), np.int64)
        count[list(bounds)] = [len(b) for b in bounds.values()]
        self.blocks += int(count[q.term].sum())
        score = np.zeros(len(shard.ids))
        for i in np.flatnonzero((reach > 0) & (reach >= self.need - EQUAL)):
            rows, scores = self._one(int(i), shard, bounds, score)
            if len(rows):
                found.append((np.full(len(rows), i), rows, scores))
        if found:
            query, rows, scores = (np.concatenate(c) for c in zip(*found, strict=True))
            self._keep((query, shard.ids[rows], scores))

    def _one(self, i: int, shard: Shard, bounds: dict[int, np.ndarray], score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of one query's best chunks in a shard; ``score`` is zero before and after."""
        q, k = self.q, self.k
        own = [(int(t), w) for t, w in zip(q.term[q.start[i] : q.start[i + 1]], q.weight[q.start[i] : q.start[i + 1]], strict=True) if int(t) in bounds and w]
        queue = sorted(((-w * b, j, block) for j, (t, w) in enumerate(own) for block, b in enumerate(bounds[t])))
        ahead = [w * bounds[t][0] for t, w in own]  # of each term, the bound of its next block
        rest, need, touched, at = sum(ahead), self.need[i], [], 0
        for at, (_, j, block) in enumerate(queue):
            if rest < need - EQUAL:
                break
            rows, gains = self._block(shard, *own[j], block)
            score[rows] += gains
            touched.append(rows)
            later = own[j][1] * bounds[own[j][0]][block + 1] if block + 1 < len(bounds[own[j][0]]) else 0.0
            rest, ahead[j] = max(0.0, rest + later - ahead[j]), later
            if at % 4 == 3 or block + 1 == len(bounds[own[j][0]]):
                need = max(need, self._kth(score, touched, shard.alive))
        else:
            at = len(queue)
        self.read += at
        seen = np.unique(np.concatenate(touched)) if touched else np.empty(0, np.int64)
        if shard.alive is not None:
            dead, seen = seen[~shard.alive[seen]], seen[shard.alive[seen]]
            score[dead] = 0.0
        seen, others = seen[score[seen] + rest >= need - EQUAL], seen[score[seen] + rest < need - EQUAL]
        score[others] = 0.0
        unread: dict[int, int] = {}
        for _, j, block in queue[at:]:
            unread[j] = min(block, unread.get(j, block))
        for j, block in unread.items() if len(seen) else ():
            term, weight = own[j]
            hit, tfs = shard.postings[term].look_up(seen, block)
            score[seen[hit]] += weight * q.gain(tfs, shard.lengths[seen[hit]])
        scores = score[seen].copy()
        score[seen] = 0.0
        if len(seen) > k:
            keep = scores >= np.partition(scores, -k)[-k] - EQUAL
            seen, scores = seen[keep], scores[keep]
        keep = scores >= self.need[i] - EQUAL
        return seen[keep], scores[keep]

    def _block(self, shard: Shard, term: int, weight: float, block: int) -> tuple[np.ndarray, np.ndarray]:
        p, part = shard.postings[term], slice(block * BLOCK, (block + 1) * BLOCK)
        rows = p.rows[part]
        return rows, weight * self.q.gain(p.tfs[part], shard.lengths[rows])

    def _kth(self, score: np.ndarray, touched: list[np.ndarray], alive: np.ndarray | None) -> float:
        """The k-th best of the sums so far: no more than what the k-th best chunk will have."""
        if sum(map(len, touched)) < self.k:
            return -np.inf
        sums = score if alive is None else np.where(alive, score, 0.0)
        if len(sums) < self.k:
            return -np.inf
        least = float(np.partition(sums, -self.k)[-self.k])
        return least if least > 0 else -np.inf

    def _keep(self, new: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
        q, c, s = new if self.rows is None else tuple(np.concatenate(p) for p in zip(self.rows, new, strict=True))
        order = np.lexsort((c, -np.round(s, 9), q))
        q, c, s = q[order], c[order], s[order]
        starts = np.flatnonzero(np.diff(q, prepend=-1))
        place = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q))))
        self.need[q[place == self.k - 1]] = s[place == self.k - 1]
        self.rows = q[place < self.k], c[place < self.k], s[place < self.k]

    def batches(self, ids: pa.DataType, queries: pa.DataType) -> Iterator[pa.RecordBatch]:
        """What leaves the task: at most k rows a query."""
        if self.rows is not None:
            q, c, s = self.rows
            yield pa.RecordBatch.from_arrays([pa.array(self.q.ids[q]).cast(queries), pa.array(c).cast(ids), pa.array(s)], names=["query_id", "chunk_id", "score"])
