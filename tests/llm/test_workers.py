"""Tasks bring the package along: workers have no copy of it on their path."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_queries_run_on_workers_without_the_package(tmp_path):
    """Started in another folder, with only the driver's own search path set."""
    code = textwrap.dedent(f"""
        import sys
        sys.path.insert(0, {str(ROOT)!r})
        import corpus_pipeline
        from assayer.llm import queries
        from assayer.session import build_session
        spark = build_session("workers", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4",
                              spark__checkpoint__dir={str(tmp_path / "shared")!r})
        for name, query in queries.QUERIES.items():
            if not name.startswith("op2_"):  # minutes of training; the same helpers as the others
                assert query(spark, "/root/testdata/sf0.001").count() > 0, name
                print("ran", name, flush=True)
    """)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYSPARK_PYTHON": sys.executable}
    tokenizers = Path(__import__("public_tokenizers").__file__).resolve().parent.parent
    # the vocabularies' own package is installed on every machine
    env["PYTHONPATH"] = str(tokenizers)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    assert done.stdout.count("ran op") == 12
