import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")
def test_core_runs_without_llm(spark, monkeypatch):
    monkeypatch.setattr(entry.importlib.util, "find_spec", lambda name: None)
    names = entry.queries()
    assert "p5_found" in names and not any(n.startswith(("p1_", "p8_")) for n in names)
