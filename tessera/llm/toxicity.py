"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Labelled examples (a bounded sample of both classes, by a hash of the id) are vectors
over all terms that at least two of them have; terms are words and their beginnings.
The weight of a term is its IDF, times more the surer it is that label 1 has it more
often (log-odds less two standard errors); every term has its share, so each text with
a known term has neighbours. The examples are held in an inverted index in blocks, with
each frequent term's largest weight in each block. A text's neighbours are found exactly:
a block is left out only if no example in it can be nearer than the k nearest known.

Neighbours vote with the square of their cosine; each stands for as many labelled
rows of its class as were left out of the sample. Votes are made into probabilities
by isotonic regression, each example voted on by an index and weights that it had
no part in.

Defined results: a text without any known term, empty and null texts included, has
no neighbour and gets the share of label 1 among such examples; without labelled rows
of both classes every score is the share of label 1 (0.5 without any). Equal cosines
go to the example that comes first in the index. A very long text is one vector of all
its terms. Repeated rows are scored each for itself; an empty table gives no rows;
columns other than the id and the text are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import within_bytes
from tessera.llm.language import held_out

#: Labelled rows to learn from, of label 0 and label 1: about so many, together at most twice as many.
TRAIN_DOCS = (4_000, 2_000)
#: Bytes of labelled texts that the driver takes at most, about; a sample of longer texts has fewer rows.
TRAIN_BYTES = 64_000_000
NEIGHBOURS = 16
BLOCK = 64
#: A term that more than one in so many examples have is kept in blocks.
FREQUENT = 16
#: Parts of the sample of which each is calibrated by the others.
FOLDS = 4
#: Texts that are searched for together.
AT_ONCE = 64
#: Words whose terms a worker remembers at most.
CACHE = 200_000
#: So many standard errors are taken off a term's log-odds.
SIGNIFICANT = 2.0
#: What each term's weight has beside its log-odds, so that no term is left out.
SHARE = 0.1
#: A term of fewer examples has no neighbours to lead to.
LEAST_DOCS = 2
#: Characters of a word's beginning that make a term of its own.
STEM = 5
#: Weight of the prior in a vote.
PRIOR = 0.05
WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    return WORDS(text.lower()) if text else []


def stems_of(words: list[str]) -> list[str]:
    return [f"{w[:STEM]}-" for w in words if len(w) > STEM]


def spans(begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the spans, one span after another."""
    ends = np.cumsum(lengths)
    places = np.repeat(begins - ends + lengths, lengths)
    places += np.arange(len(places))
    return places


def arrays(vector: dict[int, float] | tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, tuple):
        return vector
    return np.fromiter(vector.keys(), np.int64, len(vector)), np.fromiter(vector.values(), np.float64, len(vector))


class BlockMaxIndex:
    """Exact top-k inner products of sparse unit vectors by block-max pruning.

    Postings of the rarer terms are added up for every example. Terms that more than one
    in ``FREQUENT`` examples have are kept block by block, with their largest weight
    in each block: these weights, and the best that the rarer terms gave in a block, bound
    what an example of the block can have, and blocks whose bound is below a query's k-th
    best are not scored.
    """

    def __init__(self, vectors: list, block: int = BLOCK) -> None:
        self.block, self.n = block, len(vectors)
        pairs = [arrays(v) for v in vectors]
        terms = np.concatenate([t for t, _ in pairs] or [np.empty(0, np.int32)]).astype(np.int32)
        docs = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in pairs])
        order = np.argsort(terms, kind="stable")  # postings by term, then example
        terms, docs = terms[order], docs[order]
        weights = np.concatenate([w for _, w in pairs] or [np.empty(0)])[order]
        del pairs, order
        self.size = int(terms[-1]) + 1 if len(terms) else 0
        df = np.bincount(terms, minlength=self.size)
        frequent = FREQUENT * df > self.n
        self.place = np.where(frequent, np.cumsum(frequent) - 1, -1)  # of a frequent term in the blocks
        often = frequent[terms]
        self.dense = np.zeros((int(frequent.sum()), -(-self.n // block) * block))
        self.dense[self.place[terms[often]], docs[often]] = weights[often]
        self.most = self.dense.reshape(len(self.dense), -(-self.n // block), block).max(axis=2)
        self.docs, self.weights = docs[~often], weights[~often]
        self.first = np.searchsorted(terms[~often], np.arange(self.size + 1))

    def search(self, query: dict[int, float] | tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.search_many([query], k)[0]

    def search_many(self, queries: list, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each query (examples, cosines) of the k nearest with a positive cosine, nearest first."""
        m, width = len(queries), self.dense.shape[1]
        if not m or not self.n:
            return [(np.empty(0, np.int64), np.empty(0))] * m
        pairs = [arrays(q) for q in queries]
        row = np.repeat(np.arange(m), [len(t) for t, _ in pairs])
        terms, weights = np.concatenate([t for t, _ in pairs]), np.concatenate([w for _, w in pairs])
        known = terms < self.size
        row, terms, weights = row[known], terms[known], weights[known]
        place = self.place[terms] if self.size else terms
        rare = place < 0
        begins = self.first[terms[rare]]
        each = self.first[terms[rare] + 1] - begins
        postings = spans(begins, each)
        cells = np.repeat(row[rare] * width, each) + self.docs[postings]
        scores = np.bincount(cells, self.weights[postings] * np.repeat(weights[rare], each), m * width).astype(np.float64, copy=False).reshape(m, width)
        asked = np.zeros((m, len(self.dense)))
        asked[row[~rare], place[~rare]] = weights[~rare]
        blocks = scores.reshape(m, width // self.block, self.block)
        bound = asked @ self.most + blocks.max(axis=2)
        order = np.argsort(-bound, axis=1, kind="stable")
        early = order[:, : 2 + 2 * k // self.block]
        need = np.zeros(bound.shape, bool)
        np.put_along_axis(need, early, True, axis=1)
        self._add(blocks, asked, need)
        held = np.take_along_axis(blocks, early[:, :, None], axis=1).reshape(m, -1)
        least = np.partition(held, held.shape[1] - k, axis=1)[:, -k] if held.shape[1] >= k else np.zeros(m)
        later = ~need & (bound > 0) & (bound >= least[:, None] - 1e-9)
        self._add(blocks, asked, later)
        blocks[~(need | later)] = 0.0
        out = []
        for own in scores:
            docs = np.flatnonzero(own > 1e-12)
            if len(docs) > k:
                docs = docs[own[docs] >= np.partition(own[docs], len(docs) - k)[-k] - 1e-11]
            docs = docs[np.lexsort((docs, -np.round(own[docs], 12)))[:k]]
            out.append((docs, own[docs]))
        return out

    def _add(self, blocks: np.ndarray, asked: np.ndarray, need: np.ndarray) -> None:
        """Add what the frequent terms give in the needed blocks."""
        for b in np.flatnonzero(need.any(axis=0)):
            rows = np.flatnonzero(need[:, b])
            blocks[rows, b] += asked[rows] @ self.dense[:, b * self.block : (b + 1) * self.block]


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # weight, weighted sum, least x, largest x
    for xi, yi, wi in zip(x[order], y[order], w[order], strict=True):
        if pools and pools[-1][3] == xi:
            pools[-1][0] += wi
            pools[-1][1] += wi * yi
        else:
            pools.append([wi, wi * yi, xi, xi])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    knots = [(edge, p[1] / p[0]) for p in pools for edge in dict.fromkeys((p[2], p[3]))]
    return np.array([k[0] for k in knots]), np.array([k[1] for k in knots])


def counts_of(text: str | None) -> Counter:
    words = words_of(text)
    tf = Counter(words)
    tf.update(stems_of(words))
    return tf


def term_weights(rows: list, labels: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of ``size`` terms its weight, 0 if too few examples have it, and whether it speaks for label 1."""
    none, one = (np.bincount(np.concatenate([t for (t, _), y in zip(rows, labels, strict=True) if y == c]), minlength=size) for c in (0, 1))
    kept = none + one >= LEAST_DOCS
    none, one = none + 0.5, one + 0.5
    sizes = [int((labels == c).sum()) for c in (0, 1)]
    odds = np.log(one / (sizes[1] + 1)) - np.log(none / (sizes[0] + 1)) - SIGNIFICANT * np.sqrt(1 / one + 1 / none)
    return np.where(kept, (np.log((1 + len(rows)) / (one + none)) + 1) * (SHARE + np.maximum(0, odds)), 0.0), kept & (odds > 0)


def unit(terms: np.ndarray, counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    raw = counts * weights[terms]
    terms, raw = terms[raw > 0], raw[raw > 0]
    return terms, raw / math.sqrt(raw @ raw) if len(raw) else raw


class ToxicityModel:
    """Terms, index and calibration; ``score`` reads whole texts.

    Votes are calibrated by cross-fitting: the examples are dealt into ``FOLDS``, and each
    fold's are voted on with weights and neighbours of the other folds alone.
    """

    def __init__(self, ids: list, texts: list[str | None], labels: np.ndarray, totals: tuple[int, int], k: int = NEIGHBOURS) -> None:
        self.k, self.index = k, None
        self.prior = totals[1] / sum(totals) if sum(totals) else 0.5
        if not len(labels) or labels.min() == labels.max():
            return
        every: dict[str, int] = {}
        rows = []  # of each text its terms, as numbers, and how often each occurs
        for i, text in enumerate(texts):
            tf, texts[i] = counts_of(text), None  # each text is let go, for the driver's memory
            rows.append((np.fromiter((every.setdefault(t, len(every)) for t in tf), np.int32, len(tf)), np.fromiter(tf.values(), np.int32, len(tf))))
        turn = np.empty(len(labels), np.int64)
        for c in (0, 1):
            turn[labels == c] = np.arange((labels == c).sum()) % FOLDS
        votes = np.full(len(labels), -1.0)
        for fold in range(FOLDS):
            judged, base = np.flatnonzero(turn == fold), np.flatnonzero(turn != fold)
            if len(judged) and len(set(labels[base])) == 2:
                weights, _ = term_weights([rows[i] for i in base], labels[base], len(every))
                self._hold(rows, labels, base, weights, totals)
                for at in range(0, len(judged), AT_ONCE):
                    some = judged[at : at + AT_ONCE]
                    found = self.index.search_many([unit(*rows[i], weights) for i in some], k)
                    votes[some] = [self.vote(*f) if len(f[0]) else -1.0 for f in found]
        self.weights, speaking = term_weights(rows, labels, len(every))
        held = self._hold(rows, labels, np.arange(len(labels)), self.weights, totals)
        self.ids = [ids[i] for i in held]
        self.terms = {t: i for t, i in every.items() if self.weights[i]}
        self.speaking = {i: t for t, i in self.terms.items() if speaking[i]}  # terms of label 1
        stands, bare = np.array([totals[c] / (labels == c).sum() for c in (0, 1)])[labels], votes < 0
        self.bare = float(((stands * labels)[bare].sum() + self.prior) / (stands[bare].sum() + 1))
        self.knots = isotonic(votes[~bare], labels[~bare].astype(np.float64), stands[~bare]) if not bare.all() else (np.zeros(1), np.array([self.prior]))
        self._forget()

    def _hold(self, rows: list, labels: np.ndarray, base: np.ndarray, weights: np.ndarray, totals: tuple[int, int]) -> list[int]:
        """Index the examples ``base``; those alike share a block: by the label and the heaviest term in them."""
        vectors = {i: unit(*rows[i], weights) for i in base.tolist()}
        held = sorted((i for i, (t, _) in vectors.items() if len(t)), key=lambda i: (labels[i], vectors[i][0][vectors[i][1].argmax()], i))
        self.index, self.labels = None, labels[held].astype(np.float64)
        self.stands = np.array([totals[c] / max(1, (labels[base] == c).sum()) for c in (0, 1)])
        self.index = BlockMaxIndex([vectors[i] for i in held])
        return held

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.own = np.empty((4096, 2), np.int64)  # of each known word its term and its beginning's, or -1

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "own": np.empty((4096, 2), np.int64)}

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The unit TF-IDF vector of a text: known terms and weights."""
        words = words_of(text)
        if len(self.known) > CACHE:
            self._forget()
        known, terms = self.known, self.terms
        for w in set(words).difference(known):
            i = len(known)
            if i == len(self.own):
                self.own = np.concatenate([self.own, np.empty_like(self.own)])
            known[w] = i
            self.own[i] = terms.get(w, -1), terms.get(f"{w[:STEM]}-", -1) if len(w) > STEM else -1
        found = self.own[list(map(known.__getitem__, words))].ravel() if words else np.empty(0, np.int64)
        found, counts = np.unique(found[found >= 0], return_counts=True)
        return unit(found, counts, self.weights)

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        labels = self.labels[near]
        weight = cosine**2 * self.stands[labels.astype(int)]
        return float(((weight * labels).sum() + PRIOR * self.prior) / (weight.sum() + PRIOR))

    def score_many(self, texts: list[str | None]) -> list[tuple[float, list, list[float], list[str]]]:
        """Of each text the probability of label 1, neighbours' ids, their cosines, and the terms that speak for label 1."""
        if self.index is None:
            return [(self.prior, [], [], [])] * len(texts)
        vectors, out = [self.vector(t) for t in texts], []
        for (terms, _), (near, cosine) in zip(vectors, self.index.search_many(vectors, self.k), strict=True):
            if not len(near):
                out.append((self.bare, [], [], []))
                continue
            p = float(np.interp(self.vote(near, cosine), *self.knots))
            out.append((p, [self.ids[i] for i in near], [min(1.0, float(c)) for c in cosine], [self.speaking[t] for t in terms.tolist() if t in self.speaking]))
        return out

    def score(self, text: str | None) -> tuple[float, list, list[float], list[str]]:
        return self.score_many([text])[0]


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 5, remainder: int = 0, train_docs: tuple[int, int] = TRAIN_DOCS) -> ToxicityModel:
    """Learn from about ``train_docs`` labelled rows outside the held-out fold."""
    train = labels.select(F.col(id_col).alias("__key"), F.col(label_col).cast("int").alias("__label")).where(F.col("__key").isNotNull() & F.col("__label").isin(0, 1) & ~held_out("__key", modulus, remainder))
    count = {r[0]: r[1] for r in train.groupBy("__label").count().collect()}
    totals = (count.get(0, 0), count.get(1, 0))
    keep = lambda c: F.lit(1 << 62 if totals[c] <= train_docs[c] else int((1 << 62) * train_docs[c] / totals[c]))
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("toxicity"), "__key"), 2)
    chosen = train.where(turn < F.when(F.col("__label") == 1, keep(1)).otherwise(keep(0))).limit(2 * sum(train_docs))
    found = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__key")
    rows = within_bytes(found, turn, F.col("__text"), TRAIN_BYTES).select("__key", "__text", "__label").collect()
    rows.sort(key=lambda r: (r[0], r[1] or "", r[2]))
    ids, texts, marks = (list(c) for c in zip(*rows, strict=True)) if rows else ([], [], [])
    del rows  # for the driver's memory
    return ToxicityModel(ids, texts, np.array(marks, np.int64), totals)


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, score, and as evidence neighbours, cosines and terms, for every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for at in range(0, batch.num_rows, AT_ONCE) for x in shared.value.score_many(batch.column(1).slice(at, AT_ONCE).to_pylist())]
            kinds = [pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.string())]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "score", "neighbours", "cosines", "terms"])

    return rows.mapInArrow(score, "doc_id long, score double, neighbours array<long>, cosines array<double>, terms array<string>")
