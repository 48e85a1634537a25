"""The entry works without the corpus operators, and hides no error in them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); print(len(e.oracle_sql()))"


def run(folder: Path, code: str = SAY) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)


def copied(folder: Path) -> Path:
    shutil.copytree(ROOT / "logsluice", folder / "logsluice", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", folder)
    return folder


def test_without_corpus_operators(tmp_path):
    got = run(copied(tmp_path))
    assert got.returncode == 0, got.stderr
    names = got.stdout.splitlines()[0].split()
    assert "govern_logs" in names and "pipeline" not in names and not [n for n in names if n.startswith("op")]


def test_errors_in_them_are_not_hidden(tmp_path):
    folder = copied(tmp_path)
    (folder / "logsluice" / "llm").mkdir()
    (folder / "logsluice" / "llm" / "__init__.py").write_text("")
    (folder / "logsluice" / "llm" / "queries.py").write_text("import a_module_that_is_not_there\n")
    got = run(folder)
    assert got.returncode and "a_module_that_is_not_there" in got.stderr


def test_nothing_else_imports_them():
    for path in (ROOT / "logsluice").rglob("*.py"):
        if "llm" not in path.parts:
            assert "logsluice.llm" not in path.read_text(), path
