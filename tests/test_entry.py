import os
import re
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_and_queries(spark):
    import __spark_entry__ as E

    queries, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100
    assert E.entry(spark).count() > 0


def test_nothing_else_imports_the_training_data_package():
    for folder, _, names in os.walk(os.path.join(REPO, "veldspar")):
        if f"{os.sep}llm" in folder:
            continue
        for name in names:
            if name.endswith(".py"):
                assert not re.search(r"import.*\bllm\b|veldspar\.llm", open(os.path.join(folder, name)).read()), name


def test_imports_without_it(tmp_path):
    import shutil

    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op7') for k in q) and len(q) > 100"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, timeout=120)
