"""The library works when the llm folders and the pipeline are gone."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_module_without_the_subpackage(tmp_path):
    for name in ("mdlake", "__spark_entry__.py"):
        copy = shutil.copytree if (ROOT / name).is_dir() else shutil.copy
        copy(ROOT / name, tmp_path / name)
    shutil.rmtree(tmp_path / "mdlake" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and set(e.oracle_sql()) <= set(q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_the_other_tests_pass_without_it(tmp_path):
    """In a copy without the subpackage, its tests and the pipeline, all other
    tests are collected, and some of each kind are run."""
    for name in ("mdlake", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    run = lambda *args: subprocess.run([sys.executable, "-m", "pytest", "-q", "-p", "no:cacheprovider", *args], cwd=tmp_path, capture_output=True, text=True)
    every = run("tests", "--collect-only")
    assert every.returncode == 0 and "test_queries.py::test_query[block_kinds]" in every.stdout and "llm/" not in every.stdout, every.stdout[-2000:]
    some = run("tests/test_markdown.py", "tests/test_shared.py", "tests/test_queries.py", "-k", "markdown or shared or mql_rejected or document_count or test_entry")
    assert some.returncode == 0, some.stdout[-2000:]


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "mdlake").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path
