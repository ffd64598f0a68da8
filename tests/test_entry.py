"""The driver's entry and the bench name the heavy queries."""

import __spark_entry__
import bench


def test_entry_redacts_whole_documents(spark):
    assert __spark_entry__.entry(spark).columns == __spark_entry__.queries()["redacted_documents"](spark, "/root/testdata/sf0.001").columns


def test_bench_times_every_operator():
    assert {q for q in __spark_entry__.queries() if q.startswith("op") and q[2].isdigit()} | {"pipeline", "redacted_documents"} <= set(bench.HEADLINE)


def test_missing_libraries_leave_the_rest(monkeypatch):
    import builtins
    import sys

    import pytest

    pytest.importorskip("maskwright.llm.queries")
    real = builtins.__import__

    def without(name, *a, **k):
        if name == "ahocorasick":
            raise ModuleNotFoundError("No module named 'ahocorasick'", name="ahocorasick")
        return real(name, *a, **k)

    for name in [m for m in sys.modules if m.startswith("maskwright.llm") or m in ("ahocorasick", "corpus_pipeline")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    with pytest.warns(UserWarning, match="left out"):
        left = __spark_entry__.queries()
    assert "redacted_documents" in left and "op4_decontaminate" not in left and "pipeline" not in left
