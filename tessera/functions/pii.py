"""Redaction of personal data by patterns, as nested native expressions.

Patterns apply in a fixed order, each to what the one before it left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.config import CODENAMES

# Entities and their patterns, in order.
PATTERNS = [
    ("EMAIL_ADDRESS", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("PHONE_NUMBER", r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("EMPLOYEE_ID", r"\bEMP-\d{5,7}\b"),
    ("IP_ADDRESS", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("CREDIT_CARD", r"\b(?:\d{4}[- ]?){3}\d{4}\b"),
]


def codename_pattern(names: list[str] | None = None) -> str | None:
    """A pattern for the names, the defaults for an empty list; blank names are left out."""
    choices = "|".join(map(re.escape, filter(None, names or CODENAMES)))
    return rf"\b({choices})\b" if choices else None


def recognizers(codenames: list[str] | None = None) -> list[tuple[str, str]]:
    names = codename_pattern(codenames)
    return [*PATTERNS, *([("PROJECT_CODENAME", names)] if names else [])]


def redacted(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    for entity, pattern in patterns if patterns is not None else recognizers():
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"<{entity}>"))
    return text


def redaction(text: Column, patterns: list[tuple[str, str]] | None = None) -> Column:
    """A struct of the redacted text and an array of counts, in the order of the patterns, in one pass a pattern.

    Each pattern is counted and replaced on the text as it stands at its turn.
    """
    held = F.struct(text.alias("text"), F.array().cast("array<int>").alias("counts"))
    for entity, pattern in patterns if patterns is not None else recognizers():
        held = _step(held, entity, pattern)
    return held


def _step(held: Column, entity: str, pattern: str) -> Column:
    count = lambda x: F.coalesce(F.regexp_count(x["text"], F.lit(pattern)), F.lit(0))
    return F.transform(F.array(held), lambda x: F.struct(F.regexp_replace(x["text"], F.lit(pattern), F.lit(f"<{entity}>")).alias("text"), F.array_append(x["counts"], count(x)).alias("counts")))[0]


def redaction_count(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda a, x: a + x)


#: A recogniser gives, for each text, its finds as (begin, end, entity).
Recogniser = Callable[[list[str]], list[list[tuple[int, int, str]]]]


def recognised(rows: DataFrame, text_col: str, recogniser: Recogniser) -> DataFrame:
    """The rows with what a model finds (persons, say) replaced, and how often, in ``found``.

    Of finds that overlap the longer counts, of equally long ones the first.
    """
    at, names = rows.columns.index(text_col), rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            finds = recogniser([t or "" for t in texts])
            made = [replaced(t, f) for t, f in zip(texts, finds, strict=True)]
            columns = [*batch.columns[:at], pa.array([m[0] for m in made], pa.string()), *batch.columns[at + 1 :], pa.array([m[1] for m in made], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "found"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, found int")


def replaced(text: str | None, finds: list[tuple[int, int, str]]) -> tuple[str | None, int]:
    chosen: list[tuple[int, int, str]] = []
    for begin, end, entity in sorted(finds, key=lambda f: (f[0] - f[1], f[0])):
        if all(end <= b or begin >= e for b, e, _ in chosen):
            chosen.append((begin, end, entity))
    out = text or ""
    for begin, end, entity in sorted(chosen, reverse=True):
        out = f"{out[:begin]}<{entity}>{out[end:]}"
    return (out if text is not None else None), len(chosen)


def guarded(value: Column, failed: Column, closed: bool) -> Column:
    """Fail closed: an error for failed rows; fail open: the value as it is."""
    return F.when(failed, F.raise_error(F.lit("redaction failed"))).otherwise(value) if closed else value
