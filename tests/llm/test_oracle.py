"""Registered queries of this folder against their DuckDB text, and the driver contract with and without the folder."""

import builtins
import importlib

import pytest

from panelspark.llm import queries
from tests.compare import compare, duck
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    diff, n, _, _ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert diff == "" and n > 0


def test_one_query_each():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_entry_without_the_folder(monkeypatch):
    import __spark_entry__ as entry

    assert "pipeline" in entry.queries() and set(queries.QUERIES) <= set(entry.queries())
    real = builtins.__import__

    def gone(name, *args, **kw):
        if name in ("corpus_pipeline", "panelspark.llm"):
            raise ImportError(name)
        return real(name, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", gone)
    try:
        left = importlib.reload(entry).queries()
        assert left and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in left)
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
