import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

REPO = os.path.dirname(os.path.abspath(entry.__file__))


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert 'q_words' in q and 'pipeline' not in q and e.oracle_sql()"], cwd=tmp_path / "r", capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert done.returncode == 0, done.stderr


@pytest.mark.skipif(not os.path.isdir(entry.SMALL), reason="the driver's tables aren't here")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert sum(r.redactions for r in rows) > 100 and not any("@web.de" in r.redacted for r in rows)
