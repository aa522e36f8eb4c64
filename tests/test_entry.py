"""The entry point with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT / "corpusjobs", tmp_path / "corpusjobs", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_faults_in_them_are_not_passed_over(tmp_path):
    shutil.copytree(ROOT / "corpusjobs", tmp_path / "corpusjobs", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpusjobs" / "llm").mkdir()
    (tmp_path / "corpusjobs" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpusjobs" / "llm" / "queries.py").write_text("import no_such_module")
    (tmp_path / "corpus_pipeline.py").write_text("")
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode and "no_such_module" in done.stderr
