"""Quality classifier: a sparse ensemble of rules that Spark evaluates as columns.

Statistics of a whole text are native columns. On a bounded, labelled sample
(``TRAIN_DOCS``, by a hash of the id) small trees are boosted; every path from a
root to a node is a conjunctive rule over the statistics; a logistic regression
with an L1 penalty gives most rules weight 0; what is left is compiled into one
column expression, so that scoring is a projection without Python.

Defined results: a null or empty text has all statistics 0 and gets the score that
the rules give those; without labelled rows of both classes every score is the
share of label 1 (0.5 without any); labels other than 0 and 1 are no labels. A very long
text is counted as a whole; of equally good splits the first statistic and the smallest
bound is taken. Repeated rows are scored each for itself; a null id is not held out; an
empty table gives no rows; columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, SPACES
from tessera.llm.language import held_out

#: Labelled rows to learn from: about so many, never more than twice as many.
TRAIN_DOCS = 6_000
TREES = 24
DEPTH = 3
LEAST_LEAF = 20
L1 = 0.0008
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = "#*$%&|<>"
STATISTICS = ["n_chars", "n_words", "word_length", "symbol_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_share", "repeated_lines", "wide_share"]


def _lost(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among these."""
    return F.length(text) - F.length(F.translate(text, characters, ""))


def statistics(text: Column) -> dict[str, Column]:
    """Native expressions over one whole text, each 0 where it has no meaning."""
    text = F.coalesce(text, F.lit(""))
    return {
        "__words": F.filter(F.split(text, SPACE), lambda w: w != ""),
        "__lines": F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""),
        "__chars": F.length(text),
        "__bytes": F.octet_length(text),
        "__spaces": _lost(text, SPACES),
        "__symbols": _lost(text, SYMBOLS),
        "__upper": _lost(text, UPPER),
        "__digits": _lost(text, "0123456789"),
        "__marks": _lost(text, ".,;:!?"),
    }


def with_statistics(docs: DataFrame, id_col: str, text_col: str, also: list[str] | None = None) -> DataFrame:
    """The id, the named further columns, and one double column for each statistic."""
    kept = [F.col(id_col).alias("__id"), *(F.col(c).alias(f"__also_{c}") for c in also or [])]
    raw = docs.select(*kept, *(c.alias(n) for n, c in statistics(F.col(text_col)).items()))
    per = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))
    n = F.size("__words")
    c = {n: F.col(n) for n in raw.columns}
    out = {
        "n_chars": c["__chars"].cast("double"),
        "n_words": n.cast("double"),
        "word_length": per(c["__chars"] - c["__spaces"], n),
        "symbol_share": per(c["__symbols"], c["__chars"]),
        "upper_share": per(c["__upper"], c["__chars"]),
        "digit_share": per(c["__digits"], c["__chars"]),
        "mark_share": per(c["__marks"], c["__chars"]),
        "distinct_share": per(F.size(F.array_distinct("__words")), n),
        "line_share": per(F.size("__lines"), n),
        "repeated_lines": per(F.size("__lines") - F.size(F.array_distinct("__lines")), F.size("__lines")),
        "wide_share": per(c["__bytes"] - c["__chars"], c["__chars"]),
    }
    return raw.select(*[f"`{x}`" for x in raw.columns if x == "__id" or x.startswith("__also_")], *(v.alias(k) for k, v in out.items()))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is it above?, bound) hold."""

    terms: tuple[tuple[int, bool, float], ...]

    def of(self, x: np.ndarray) -> np.ndarray:
        hit = np.ones(len(x), bool)
        for k, above, bound in self.terms:
            hit &= (x[:, k] > bound) == above
        return hit

    def column(self, names: list[str]) -> Column:
        hit = F.lit(True)
        for k, above, bound in self.terms:
            hit = hit & ((F.col(names[k]) > bound) if above else (F.col(names[k]) <= bound))
        return hit


@dataclass
class RuleEnsemble:
    names: list[str]
    bias: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            at += weight * rule.of(x)
        return 1 / (1 + np.exp(-at))

    def column(self) -> Column:
        at = F.lit(float(self.bias))
        for rule, weight in self.rules:
            at = at + F.when(rule.column(self.names), float(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-at))


def _split(x: np.ndarray, residual: np.ndarray, rows: np.ndarray, least: int) -> tuple[float, int, float] | None:
    """The split of these rows that lowers the squared error most: gain, statistic, bound."""
    best = None
    total, n = residual[rows].sum(), len(rows)
    for k in range(x.shape[1]):
        order = rows[np.argsort(x[rows, k], kind="stable")]
        v, left = x[order, k], np.cumsum(residual[order])[:-1]
        count = np.arange(1, n)
        gain = left**2 / count + (total - left) ** 2 / (n - count) - total**2 / n
        gain[(v[1:] == v[:-1]) | (count < least) | (n - count < least)] = -1
        if len(gain) and (i := int(np.argmax(gain))) >= 0 and gain[i] > 1e-9 and (best is None or gain[i] > best[0]):
            best = float(gain[i]), k, float((v[i] + v[i + 1]) / 2)
    return best


def _tree(x: np.ndarray, residual: np.ndarray, depth: int, least: int) -> list[tuple[Rule, np.ndarray]]:
    """Every node below the root as a rule with its rows; the leaves are last of their path."""
    found, todo = [], [((), np.arange(len(x)))]
    while todo:
        terms, rows = todo.pop()
        if len(terms) < depth and len(rows) >= 2 * least and (cut := _split(x, residual, rows, least)):
            _, k, bound = cut
            for above in (False, True):
                own = (Rule((*terms, (k, above, bound))), rows[(x[rows, k] > bound) == above])
                found.append(own)
                todo.append((own[0].terms, own[1]))
    return found


def _lasso(h: np.ndarray, y: np.ndarray, l1: float, rounds: int = 1500) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient."""
    n, m = h.shape
    bias, w = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), np.zeros(m)
    step = 4 / (np.linalg.norm(np.c_[np.ones(n), h], 2) ** 2 / n)
    vb, v, t = bias, w.copy(), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(vb + h @ v))) - y
        nb, nw = vb - step * error.mean(), v - step * (h.T @ error) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        vb, v = nb + (t - 1) / nt * (nb - bias), nw + (t - 1) / nt * (nw - w)
        if abs(nb - bias) + np.abs(nw - w).max(initial=0) < 1e-6:
            break
        bias, w, t = nb, nw, nt
    return bias, w


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], *, trees: int = TREES, depth: int = DEPTH, least: int = LEAST_LEAF, l1: float = L1, rate: float = 0.3) -> RuleEnsemble:
    """Boost trees on the logistic loss, take all their rules, keep what the lasso keeps."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        share = min(max(share, 1e-4), 1 - 1e-4)
        return RuleEnsemble(names, float(np.log(share / (1 - share))))
    at, rules = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-at))
        nodes = _tree(x, y - p, depth, least)
        if not nodes:
            break
        inner = {rule.terms[:-1] for rule, _ in nodes}
        for rule, rows in nodes:
            rules[rule] = None
            if rule.terms not in inner:
                at[rows] += rate * (y - p)[rows].sum() / max(1e-6, (p * (1 - p))[rows].sum()) if len(rows) else 0
        at = np.clip(at, -12, 12)
    kept = list(rules)
    if not kept:
        return RuleEnsemble(names, float(np.log(y.mean() / (1 - y.mean()))))
    bias, w = _lasso(np.column_stack([r.of(x) for r in kept]).astype(np.float64), y.astype(np.float64), l1)
    return RuleEnsemble(names, bias, [(r, float(v)) for r, v in zip(kept, w, strict=True) if v])


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", modulus: int = 5, remainder: int = 0, train_docs: int = TRAIN_DOCS) -> RuleEnsemble:
    """Learn from about ``train_docs`` labelled rows outside the held-out fold.

    Only their ids are looked up in ``docs``; a bounded number of rows of numbers
    reaches the driver.
    """
    train = labels.select(F.col(id_col).alias("__key"), F.col(label_col).alias("__label")).where(F.col("__key").isNotNull() & F.col("__label").isin(0, 1) & ~held_out("__key", modulus, remainder))
    total = train.count()
    keep = 1 << 62 if total <= train_docs else int((1 << 62) * train_docs / total)
    chosen = train.where(F.shiftrightunsigned(F.xxhash64(F.lit("quality"), "__key"), 2) < keep).limit(2 * train_docs)
    texts = docs.select(F.col(id_col).alias("__key"), F.col(text_col).alias("__text")).join(F.broadcast(chosen), "__key")  # at most 2 * train_docs rows
    rows = with_statistics(texts, "__key", "__text", ["__label"]).orderBy("__id").limit(2 * train_docs).collect()
    x = np.array([[r[s] for s in STATISTICS] for r in rows], np.float64).reshape(len(rows), len(STATISTICS))
    return fit_rules(x, np.array([r["__also___label"] for r in rows], np.float64), STATISTICS)


def score_quality(docs: DataFrame, model: RuleEnsemble, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score every row: the id (or the columns ``keep``) and score."""
    scored = with_statistics(docs, id_col, text_col, keep)
    out = [F.col("__id").alias(id_col)] if keep is None else [F.col(f"`__also_{c}`").alias(c) for c in keep]
    return scored.select(*out, model.column().alias("score"))
