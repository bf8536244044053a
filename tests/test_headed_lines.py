"""The letters of a line are taken once, however many headings are made of them."""

from __future__ import annotations

from tests.conftest import SF

from tessera.queries import QUERIES


def test_a_line_is_stripped_once(spark):
    for name in ("heading_lines", "heading_sections"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("[^A-Za-z ]") == 1
