import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tidewell.plans import catalogue, state  # noqa: F401  (registers its queries)

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_its_sql(name, agree):
    agree(catalogue.QUERIES[name], catalogue.ORACLES[name])


def test_word_accuracy_is_below_one(spark, sf):
    rows = catalogue.QUERIES["word_accuracy"](spark, sf).collect()
    assert rows and all(0.8 < r.accuracy < 1 for r in rows)


def test_entry_gives_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["doc_id", "delta"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_works_without_the_training_data_parts(tmp_path):
    shutil.copytree(ROOT / "tidewell", tmp_path / "tidewell", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') and n[2].isdigit() for n in e.queries()))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(catalogue.QUERIES)), "False"], done.stderr


def test_every_module_imports_without_the_training_data_parts():
    for path in (ROOT / "tidewell").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text(), path
