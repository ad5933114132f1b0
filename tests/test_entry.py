"""The entry works without its optional part."""

import subprocess
import sys

import pytest
from conftest import ROOT
from dialmetrics.plans.registry import queries


@pytest.mark.parametrize("blocked", ["zstandard", "numpy", "dialmetrics.llm", "corpus_pipeline"])
def test_reports_stay_where_an_import_fails(blocked):
    """With a library (or the whole part) missing, all reports and their oracles are there."""
    code = (f"import sys; sys.path.insert(0, {ROOT!r}); sys.modules[{blocked!r}] = None; import __spark_entry__ as E; "
            "print(*E.queries()); print(*E.oracle_sql())")
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd="/tmp", check=True)
    names, oracles = (line.split() for line in done.stdout.splitlines()[-2:])
    assert set(queries()) <= set(names) & set(oracles)
    assert "left out" in done.stderr and "pipeline" not in names
    if blocked != "corpus_pipeline":
        assert set(names) == set(queries())
