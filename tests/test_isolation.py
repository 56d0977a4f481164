"""The library without its corpus subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LEFT_OUT = ("panelwright/llm", "tests/llm")
NAMES = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 60 and set(o) <= set(q); print(*[n for n in q if n.startswith('op') and n[2].isdigit() or n == 'pipeline'])"


def _run(root: Path, *args: str) -> subprocess.CompletedProcess:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    # what public_tokenizers needs stays on the path
    env["PYTHONPATH"] = os.pathsep.join(x for x in os.environ.get("PYTHONPATH", "").split(os.pathsep) if x and Path(x).resolve() != ROOT)
    return subprocess.run([sys.executable, *args], cwd=root, env=env, capture_output=True, text=True, timeout=300)


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_without_the_subpackage(tmp_path, with_pipeline):
    skip = shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", ".hypothesis")
    shutil.copytree(ROOT, tmp_path / "copy", ignore=skip)
    for folder in LEFT_OUT:
        shutil.rmtree(tmp_path / "copy" / folder, ignore_errors=True)
    if not with_pipeline:
        (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
    made = _run(tmp_path / "copy", "-W", "error", "-c", NAMES)
    assert made.returncode == 0, made.stderr
    assert made.stdout.split() == []
    collected = _run(tmp_path / "copy", "-m", "pytest", "--collect-only", "-q", "tests")
    assert collected.returncode == 0, collected.stdout + collected.stderr
