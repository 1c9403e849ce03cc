"""Without the corpus folder the rest still imports, and the registries stay whole."""

import os
import re
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_corpus_folders(tmp_path, pipeline):
    """The whole repository less the corpus folders, with corpus_pipeline.py and without."""
    gone = ["llm", "__pycache__", ".git", *([] if pipeline else ["corpus_pipeline.py"])]
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(*gone))
    assert (tmp_path / "repo" / "corpus_pipeline.py").exists() == (pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bucket_confidence' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env=env, check=True, timeout=120)
    some = "test_registries_agree or test_entry or (test_same_rows and (path_role or status_counts))"
    subprocess.run([sys.executable, "-m", "pytest", "-q", "tests/test_oracle.py", "-k", some, "-p", "no:cacheprovider"], cwd=tmp_path / "repo", env=env, check=True, timeout=300)


def test_nothing_else_imports_the_corpus_folder():
    for folder, _, files in os.walk(os.path.join(ROOT, "factloom")):
        if "llm" not in folder:
            for name in files:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name), encoding="utf-8") as f:
                        assert not re.search(r"(?m)^\s*(from|import)\b.*\bllm\b", f.read()), name
