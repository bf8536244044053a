"""Language identification by multilingual mixture inference.

A document is a mixture of languages: each of its words comes from one language,
whose likelihood is that of the word's characters under an interpolated trigram
model. Expectation-maximisation estimates the document's language proportions.
The set of languages is then chosen by penalised likelihood: languages are added
in order of their proportion while each raises the log-likelihood of the words by
more than ``PENALTY`` plus the logarithm of the number of words. The prediction is the
language with the largest proportion when the words are shared among the chosen set
alone, and that proportion is its score.

The models are learned from a bounded sample of whole training texts
(``TRAIN_DOCS`` for each language, ``TRAIN_BYTES`` in all, by a hash of the id). Scoring
reads every text.

Defined results: a null text, an empty text and a text without a letter give
``und`` with score 0; so does every text if nothing could be learned. Equal
proportions go to the language that sorts first. A very long text is scored as a whole,
word by word. Repeated rows are scored each for itself; an empty table gives no rows;
other columns, whatever their names, are not looked at.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import within_bytes
from tessera.llm.tokens import release

#: Training texts of each language at most twice this number, about this number.
TRAIN_DOCS = 500
#: Training texts of all languages together, when there are many of them.
ALL_DOCS = 20_000
#: Bytes of training texts that the driver takes at most, about.
TRAIN_BYTES = 64_000_000
PENALTY = 2.0
ROUNDS = 25
WEIGHTS = (0.7, 0.2, 0.09, 0.01)
CACHE = 150_000
UNDETERMINED = "und"
WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in small letters; numerals such as superscripts are no letters."""
    words = WORDS(text.lower()) if text else []
    if all(map(str.isalpha, words)):
        return words
    return "".join([c if c.isalpha() else " " for c in " ".join(words)]).split()


class NgramModels:
    """Log-likelihoods of words under every language.

    ``rows`` numbers trigrams, bigrams and single characters seen in training;
    ``table`` holds the log-probability of each one's last character, by language.
    """

    def __init__(self, texts: dict[str, list[str]]) -> None:
        self.languages = sorted(texts)
        counts: list[list[Counter]] = []
        for language in self.languages:
            words = Counter(w for text in texts[language] for w in words_of(text))
            grams = [Counter(), Counter(), Counter()]
            for word, n in words.items():
                padded = f"  {word} "
                for i in range(2, len(padded)):
                    for size in (0, 1, 2):
                        grams[size][padded[i - size : i + 1]] += n
            counts.append(grams)
        alphabet = 1 + len({g for grams in counts for g in grams[0]})
        contexts = [[_contexts(grams[size]) for size in (1, 2)] for grams in counts]
        self.rows: dict[str, int] = {}
        table = [[math.log(WEIGHTS[3] / alphabet)] * len(self.languages)]
        for size in (0, 1, 2):
            for gram in sorted({g for grams in counts for g in grams[size]}):
                self.rows[gram] = len(table)
                table.append([math.log(_mixed(gram, counts[k], contexts[k], alphabet)) for k in range(len(self.languages))])
        self.table = np.array(table)

    def numbers(self, word: str) -> list[int]:
        padded, rows = f"  {word} ", self.rows
        return [rows.get(padded[i - 2 : i + 1]) or rows.get(padded[i - 1 : i + 1]) or rows.get(padded[i]) or 0 for i in range(2, len(padded))]


def _contexts(grams: Counter) -> dict[str, int]:
    total: dict[str, int] = defaultdict(int)
    for gram, n in grams.items():
        total[gram[:-1]] += n
    return dict(total)


def _mixed(gram: str, grams: list[Counter], contexts: list[dict[str, int]], alphabet: int) -> float:
    """The interpolated probability of the last character after those before it."""
    p = WEIGHTS[3] / alphabet + WEIGHTS[2] * grams[0][gram[-1]] / max(1, grams[0].total())
    if len(gram) > 1:
        p += WEIGHTS[1] * grams[1][gram[-2:]] / max(1, contexts[0].get(gram[-2:-1], 0))
    if len(gram) > 2:
        p += WEIGHTS[0] * grams[2][gram] / max(1, contexts[1].get(gram[:-1], 0))
    return p


def proportions(likelihood: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights by expectation-maximisation; likelihood: words by languages."""
    weights = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    for _ in range(rounds):
        shares = likelihood * weights
        new = (shares / shares.sum(axis=1, keepdims=True)).mean(axis=0)
        if np.abs(new - weights).max() < 1e-4:
            return new
        weights = new
    return weights


def language_set(likelihood: np.ndarray, weights: np.ndarray, penalty: float = PENALTY) -> list[int]:
    """Languages, largest proportion first, each of which pays for itself."""
    order = np.argsort(-weights, kind="stable")
    chosen, price = [int(order[0])], penalty + math.log(len(likelihood))
    at = np.log(likelihood[:, order[0]]).sum()
    for k in order[1:]:
        if weights[k] * len(likelihood) < 1:
            break
        both = likelihood[:, [*chosen, int(k)]]
        gain = np.log(both @ proportions(both, 10)).sum()
        if gain - at <= price:
            break
        chosen.append(int(k))
        at = gain
    return chosen


class Identifier:
    """Scores whole texts, with a bounded cache of words."""

    def __init__(self, models: NgramModels) -> None:
        self.models = models
        self._anew()

    def _anew(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.empty((4096, len(self.models.languages)))

    def _learn(self, words: list[str]) -> None:
        numbers = [self.models.numbers(w) for w in words]
        begins = np.cumsum([0, *map(len, numbers[:-1])])
        sums = np.add.reduceat(self.models.table[[n for own in numbers for n in own]], begins, axis=0)
        at, end = len(self.known), len(self.known) + len(words)
        while end > len(self.values):
            self.values = np.concatenate([self.values, np.empty_like(self.values)])
        self.values[at:end] = sums
        self.known.update(zip(words, range(at, end), strict=True))

    def score(self, text: str | None) -> tuple[str, float, list[str], list[float]]:
        """The leading language of the chosen set, its proportion there, and the whole set with its proportions."""
        words = words_of(text)
        if not words or not self.models.languages:
            return UNDETERMINED, 0.0, [], []
        if len(self.known) > CACHE:
            self._anew()
        known = self.known
        new = list(dict.fromkeys(w for w in words if w not in known))
        if new:
            self._learn(new)
        logs = self.values[[known[w] for w in words]]
        likelihood = np.exp(logs - logs.max(axis=1, keepdims=True)) + 1e-12
        chosen = language_set(likelihood, proportions(likelihood))
        shares = proportions(likelihood[:, chosen])
        order = sorted(range(len(chosen)), key=lambda i: (-shares[i], chosen[i]))
        names = [self.models.languages[chosen[i]] for i in order]
        return names[0], float(min(1.0, shares[order[0]])), names, [float(shares[i]) for i in order]


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text has this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def fit_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2, train_docs: int = TRAIN_DOCS) -> NgramModels:
    """Learn from about ``train_docs`` whole texts of each language outside the held-out fold."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    train = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id", modulus, remainder))
    totals = {r.lang: r.n for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return NgramModels({})
    train_docs = max(1, min(train_docs, ALL_DOCS // len(totals)))
    keep = F.create_map([F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, 1 << 62 if n <= train_docs else int((1 << 62) * train_docs / n))])
    turn = F.shiftrightunsigned(F.xxhash64(F.lit("language"), "id"), 2)
    chosen = train.where(turn < keep[F.col("lang")])
    texts: dict[str, list[str]] = {}
    for r in within_bytes(chosen, turn, F.col("text"), TRAIN_BYTES).select("lang", "text").collect():
        texts.setdefault(r.lang, []).append(r.text)
    return NgramModels(texts)


def identify_languages(docs: DataFrame, models: NgramModels, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row a document: its id, lang_pred, score, languages and their shares.

    ``keep`` names further columns that are carried along unchanged.
    """
    keep = [id_col] if keep is None else keep
    carried = docs.select(*(f"`{c}`" for c in keep), *([] if text_col in keep else [f"`{text_col}`"]))
    at, width = carried.columns.index(text_col), len(keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in carried.schema.fields[:width])

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        scorer = Identifier(models)
        for batch in batches:
            found = [scorer.score(x.as_py()) for x in batch.column(at)]
            names = ["lang_pred", "score", "languages", "shares"]
            kinds = [pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())]
            new = [pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)] if found else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *new], names=[*batch.schema.names[:width], *names])

    return carried.mapInArrow(identify, f"{fields}, lang_pred string, score double, languages array<string>, shares array<double>")
