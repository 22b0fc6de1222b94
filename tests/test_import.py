"""The registry must be readable before there is any session."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_registry_is_read_in_a_fresh_process_without_a_session():
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout) > 50


def test_registry_is_read_without_the_training_data_operators(tmp_path):
    import shutil

    shutil.copytree(os.path.join(ROOT, "mzframe"), tmp_path / "mzframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert out.returncode == 0, out.stderr
    (tmp_path / "mzframe" / "llm").mkdir()
    (tmp_path / "mzframe" / "llm" / "__init__.py").touch()
    (tmp_path / "mzframe" / "llm" / "queries.py").write_text("import nothing_of_that_name\n")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=False)
    assert out.returncode and "nothing_of_that_name" in out.stderr
