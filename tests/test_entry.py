import importlib
import sys

import pytest


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_llm_folders(monkeypatch):
    for name in [n for n in sys.modules if n.startswith(("voxelgrove.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "voxelgrove.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    e = importlib.import_module("__spark_entry__")
    assert e.queries() and not [n for n in e.queries() if n.startswith("op") or n == "pipeline"]
    monkeypatch.delitem(sys.modules, "__spark_entry__")


def test_other_parts_don_t_import_llm():
    from pathlib import Path

    root = Path(__file__).resolve().parents[1] / "voxelgrove"
    for f in root.rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f


@pytest.mark.parametrize("module", ["operators", "sources", "functions", "jobs", "streaming"])
def test_packages(module):
    assert importlib.import_module(f"voxelgrove.{module}").__doc__


def test_a_broken_subpackage_is_an_error(monkeypatch, tmp_path):
    import __spark_entry__ as e

    (tmp_path / "hollow").mkdir()
    (tmp_path / "hollow" / "__init__.py").write_text("import a_module_that_is_missing")
    monkeypatch.syspath_prepend(str(tmp_path))
    with pytest.raises(ModuleNotFoundError):
        e._present("hollow.queries")
    assert not e._present("voxelgrove.absent.queries") and e._present("voxelgrove.jobs.programs")
