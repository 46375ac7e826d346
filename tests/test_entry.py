from __future__ import annotations

import importlib
import sys

import __spark_entry__


def test_flagship(spark):
    rows = {r["method"]: r["mean_hit"] for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {"bm25", "dense", "hybrid"} and rows["bm25"] > 0


def test_works_without_the_optional_parts(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("sedgewood.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "sedgewood.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    bare = importlib.reload(__spark_entry__)
    assert "bm25_topk" in bare.queries() and not any(q.startswith("op1_") for q in bare.queries())
    assert set(bare.oracle_sql()) <= set(bare.queries())
    monkeypatch.undo()
    importlib.reload(__spark_entry__)
