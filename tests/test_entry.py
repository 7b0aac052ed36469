"""The entry module with and without the text operators."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(folder, code="import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": folder}).stdout.split()


def test_queries_are_there():
    assert "cube_case_histogram" in names(REPO)


def test_rest_works_without_the_text_operators(tmp_path):
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    got = names(str(tmp_path / "r"))
    assert "cube_case_histogram" in got and not any(n.startswith("op") or n == "pipeline" for n in got)


def test_nothing_else_names_the_text_operators():
    for folder, _, files in os.walk(os.path.join(REPO, "strataq")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert ".llm" not in open(os.path.join(folder, f)).read()


def test_entry(spark):
    import __spark_entry__

    if os.path.isdir("/root/testdata/sf0.001"):
        assert __spark_entry__.entry(spark).count() > 0
