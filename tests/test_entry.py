"""The entry point keeps the other queries when the optional subpackage or one of its libraries is missing."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "orderloom.llm", "corpus_pipeline"])
def test_other_queries_stay(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None\n"
        "import __spark_entry__ as entry\n"
        "from orderloom.plans import oracle, registry\n"
        "assert set(registry.registered()) <= set(entry.queries()) and set(oracle.statements()) <= set(entry.oracle_sql())\n"
        "assert 'pipeline' not in entry.queries()\n"
        "assert set(entry.oracle_sql()) <= set(entry.queries())\n"
    )
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
