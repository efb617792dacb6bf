"""The driver contract."""

from __future__ import annotations

import importlib
import sys

import __spark_entry__ as entry


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 30


def test_imports_without_the_training_operators(monkeypatch):
    monkeypatch.setitem(sys.modules, "logwarden.llm", None)
    monkeypatch.delitem(sys.modules, "logwarden.llm.queries", raising=False)
    fresh = importlib.reload(entry)
    assert not [q for q in fresh.queries() if q.startswith("op") and q[2:3].isdigit()]
    assert "decisions" in fresh.queries()
    monkeypatch.undo()
    importlib.reload(entry)


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.count() == 69
    assert {r[0] for r in rows.select("entity_value").distinct().collect()} == {"203.0.113.0/24", "netbot/1.0"}
