"""The other queries register without the training operators or a library they need."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("missing", ["tokenizers", "public_tokenizers", "assayer.llm", "corpus_pipeline"])
def test_without_a_module(missing):
    code = (f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; "
            "print(len(e.queries()), sum(k.startswith('op') and k[2].isdigit() for k in e.queries()), len(e.oracle_sql()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    queries, numbered, oracles = map(int, done.stdout.split())
    assert queries >= 156 and numbered == 0 and oracles >= 150
