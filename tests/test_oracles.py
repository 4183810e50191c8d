"""Every registered query against its SQL twin, on the smallest scale."""

from __future__ import annotations

import os
import sys

import pytest

import __spark_entry__ as entry
from postmatch.plans import registered

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import compare as tool

SF = "/root/testdata/sf0.001"
#: The queries of this package's own operators; those of a subpackage are tested beside it.
QUERIES = registered.QUERIES
TWINS = {name: sql for name, sql in entry.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def con():
    return tool.connect(SF)


def test_twins_belong_to_queries():
    assert set(TWINS) <= set(QUERIES)
    assert set(QUERIES) - set(TWINS) == {"analysis_prompts", "wizard_preferences", "streamed_wizard"}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert tool.compare(spark, con, name, QUERIES[name], TWINS.get(name), SF) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_streamed_wizard_equals_batch(spark):
    batch, stream = (sorted(map(str, QUERIES[n](spark, SF).collect())) for n in ("wizard_preferences", "streamed_wizard"))
    assert batch == stream
