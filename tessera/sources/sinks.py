"""Writers: CSV, JSON lines, Markdown tables, and the text format of metric scrapers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """(ord, line): a Markdown table of a small report, ordered by its columns."""
    cell = lambda c: F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *map(cell, df.columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(0, "| " + " | ".join(df.columns) + " |"), (1, "|" + "---|" * len(df.columns))], "ord long, line string")
    return head.union(df.select(F.lit(2).cast("long").alias("ord"), line.alias("line"))).orderBy("ord", "line")


def exposition(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(ord, line): request counters (intent, status, n) and totals (name, value) in exposition format.

    Totals are active_requests, pii_redactions, prompt_tokens, completion_tokens,
    duration_sum and duration_count; missing ones count as 0.
    """
    of: dict[str, Column] = {n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("value"))), F.lit(0.0)) for n in ("active_requests", "pii_redactions", "prompt_tokens", "completion_tokens", "duration_sum", "duration_count")}
    one = totals.agg(*(c.alias(n) for n, c in of.items()))
    whole = lambda c: F.col(c).cast("long").cast("string")
    about = lambda at, name, what, kind: [(at, F.lit(f"# HELP {name} {what}")), (at + 1, F.lit(f"# TYPE {name} {kind}"))]
    # Names and help texts that scrapers know.
    lines = [
        *about(0, "gateway_active_requests", "Current in-flight inference requests.", "gauge"),
        (2, F.concat(F.lit("gateway_active_requests "), F.greatest(F.lit(0), F.col("active_requests").cast("long")).cast("string"))),
        *about(3, "gateway_requests_total", "Total number of chat completions processed.", "counter"),
        *about(6, "gateway_pii_redactions_total", "Total number of sensitive PII entities redacted.", "counter"),
        (8, F.concat(F.lit("gateway_pii_redactions_total "), whole("pii_redactions"))),
        *about(9, "gateway_tokens_total", "Total tokens processed and generated.", "counter"),
        (11, F.concat(F.lit('gateway_tokens_total{type="prompt"} '), whole("prompt_tokens"))),
        (12, F.concat(F.lit('gateway_tokens_total{type="completion"} '), whole("completion_tokens"))),
        *about(13, "gateway_request_duration_seconds", "Total execution time for chat completion requests.", "summary"),
        (15, F.concat(F.lit("gateway_request_duration_seconds_sum "), F.format_string("%.6f", F.col("duration_sum")))),
        (16, F.concat(F.lit("gateway_request_duration_seconds_count "), whole("duration_count"))),
    ]
    fixed = one.select(F.explode(F.array(*(F.struct(F.lit(at).cast("long").alias("ord"), text.alias("line")) for at, text in lines))).alias("x")).select("x.*")
    own = counts.select(F.lit(5).cast("long").alias("ord"), F.format_string('gateway_requests_total{intent="%s",status="%s"} %d', "intent", F.col("status").cast("string"), F.col("n").cast("long")).alias("line"))
    none = counts.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(5).cast("long").alias("ord"), F.lit('gateway_requests_total{intent="none",status="200"} 0').alias("line"))
    return fixed.union(own).union(none).orderBy("ord", "line")
