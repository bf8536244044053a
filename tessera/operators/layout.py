"""Page text from layout rows: text blocks and tables in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import clean_lines, strip_ws


def layout_text(blocks: DataFrame, tables: DataFrame, key: list[str] | None = None) -> DataFrame:
    """(key, text) of pages: blocks and tables ordered by top and left edge, cleaned by lines.

    Both tables have key, x0, y0, x1, y1 and text. A block that lies in a table by more
    than half of its area is left out; every table with text comes once. Pages are joined
    by key, so that only rows of one page are compared.
    """
    key = key or ["doc_id", "page"]
    box = F.col("text").isNotNull() & (strip_ws(F.col("text")) != "")
    t = tables.where(box).select(*key, *(F.col(c).alias(f"t{c}") for c in ("x0", "y0", "x1", "y1")))
    side = lambda a, b: F.greatest(F.lit(0.0), F.least(f"{b}1", f"t{b}1") - F.greatest(f"{a}0", f"t{a}0"))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    inside = blocks.where(box).join(t, key).where((area > 0) & (side("x", "x") * side("y", "y") > 0.5 * area)).select(*key, "x0", "y0", "x1", "y1").distinct()
    columns = [*key, "x0", "y0", F.col("text")]
    items = blocks.where(box).join(inside, [*key, "x0", "y0", "x1", "y1"], "left_anti").select(*columns).union(tables.where(box).select(*columns))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("y0", "x0", "text"))), lambda x: x["text"])
    return items.groupBy(*key).agg(clean_lines(F.array_join(ordered, "\n\n")).alias("text"))
