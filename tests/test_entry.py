import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "tests", "spark-warehouse"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q) and 'pipeline' not in q; print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": str(tmp_path / "r")}, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_nothing_else_imports_it():
    for base, dirs, names in os.walk(os.path.join(ROOT, "kgspark")):
        if os.path.basename(base) == "llm":
            dirs.clear()
            continue
        for n in names:
            if n.endswith(".py"):
                assert ".llm" not in open(os.path.join(base, n)).read(), n
