"""The entry module with and without the operators on texts."""

import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


@pytest.mark.parametrize("pipeline", [True, False])
@pytest.mark.parametrize("leftovers", [True, False])
def test_entry_without_the_operators_on_texts(tmp_path, pipeline, leftovers):
    names = ["aeromosaic", "__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]
    for name in names:
        path = os.path.join(ROOT, name)
        if os.path.isdir(path):
            shutil.copytree(path, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(path):
            shutil.copy(path, tmp_path / name)
    if leftovers:
        (tmp_path / "aeromosaic" / "llm" / "__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print('NAMES', *e.queries()); print('SQL', *e.oracle_sql())"
    said = subprocess.run(
        [sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True,
        env=os.environ | {"PYTHONPATH": str(tmp_path)},
    )
    assert said.returncode == 0, said.stderr
    names = said.stdout.partition("NAMES")[2].split()
    assert "t4_refit" in names and "w8_blend" in names
    assert not [n for n in names if n.startswith("op") or n == "pipeline"]
