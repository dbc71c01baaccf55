"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder):
    code = "import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, env=os.environ | {"PYTHONPATH": folder}, capture_output=True, text=True, check=True).stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/kinforge", tmp_path / "kinforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    found = names(str(tmp_path))
    assert "pk_report" in found and not [n for n in found if n.startswith("op") or n == "pipeline"]


def test_nothing_else_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/kinforge"):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(f"{folder}/{f}").read()


def test_flagship_holds(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert {r["violations"] for r in __spark_entry__.entry(spark).collect()} == {0}
