"""The entry file works with and without the training-data operators."""

import builtins
import importlib.util

import pytest

import __spark_entry__ as E


def _without(monkeypatch, *names):
    real = builtins.__import__

    def fake(name, *a, **k):
        if any(name == n or name.startswith(n + ".") for n in names):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return real(name, *a, **k)
    monkeypatch.setattr(builtins, "__import__", fake)


def test_without_the_subpackage(monkeypatch):
    _without(monkeypatch, "tollgate.llm", "corpus_pipeline")
    found = E.queries()
    assert "status_mix" in found and not [n for n in found if n.startswith("op") or n == "pipeline"]
    assert set(E.oracle_sql()) <= set(found)


def test_other_import_errors_are_not_hidden(monkeypatch):
    if importlib.util.find_spec("tollgate.llm") is None:
        pytest.skip("the subpackage is not here")
    real = builtins.__import__

    def fake(name, *a, **k):
        if name == "tollgate.llm.queries":
            raise ModuleNotFoundError("No module named 'numpy'", name="numpy")
        return real(name, *a, **k)
    monkeypatch.setattr(builtins, "__import__", fake)
    with pytest.raises(ModuleNotFoundError):
        E.queries()
