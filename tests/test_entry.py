"""The entry module, with and without the optional subpackage."""

import importlib
import os
import sys

import pytest

import __spark_entry__ as entry
from fieldcast.queries import QUERIES, SQL


def test_registry():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_optional_subpackage(monkeypatch):
    for name in [n for n in sys.modules if n.startswith("fieldcast.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "fieldcast.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(QUERIES) and set(again.oracle_sql()) == set(SQL)
    monkeypatch.undo()
    importlib.reload(entry)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).columns == ["fold", "market", "team", "shown", "avail", "rate"]
