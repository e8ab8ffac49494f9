"""The entry module with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest

from .conftest import ROOT

NAMES = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"


def run(folder):
    env = os.environ | {"PYTHONPATH": "", "PYTHONDONTWRITEBYTECODE": "1"}
    return subprocess.run([sys.executable, "-c", NAMES], cwd=folder, env=env, capture_output=True, text=True, timeout=120)


@pytest.mark.parametrize("gone", [("prismalake/llm",), ("prismalake/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
@pytest.mark.parametrize("empty_folder", [False, True])
def test_imports_without_the_subpackage(tmp_path, gone, empty_folder):
    there = os.path.isdir(f"{ROOT}/prismalake/llm")
    shutil.copytree(f"{ROOT}/prismalake", tmp_path / "prismalake", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.exists(f"{ROOT}/{name}"):
            shutil.copy(f"{ROOT}/{name}", tmp_path)
    for name in gone:
        shutil.rmtree(tmp_path / name, ignore_errors=True)
        (tmp_path / name).unlink(missing_ok=True)
        if empty_folder and not name.endswith(".py"):
            (tmp_path / name / "__pycache__").mkdir(parents=True)
    done = run(tmp_path)
    assert done.returncode == 0, done.stderr
    found, _, optional = map(int, done.stdout.split())
    assert found > 200
    assert optional == (10 if there and gone == ("corpus_pipeline.py",) else 0)


@pytest.mark.skipif(not os.path.isdir(f"{ROOT}/prismalake/llm"), reason="the subpackage has been removed")
def test_a_broken_subpackage_is_an_error(tmp_path):
    shutil.copytree(f"{ROOT}/prismalake", tmp_path / "prismalake", ignore=shutil.ignore_patterns("__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "prismalake/llm/mixing.py").unlink()
    done = run(tmp_path)
    assert done.returncode and "mixing" in done.stderr
