"""The driver's contract, with and without the language-model subpackage."""

import importlib
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    assert importlib.import_module("__spark_entry__").entry(spark).limit(1).count() == 1


def test_names():
    e = importlib.import_module("__spark_entry__")
    assert set(e.oracle_sql()) <= set(e.queries())


def test_without_the_subpackage(tmp_path):
    (tmp_path / "corpusloom").mkdir()
    for x in (ROOT / "corpusloom").iterdir():
        if x.name not in ("llm", "__pycache__"):
            (tmp_path / "corpusloom" / x.name).symlink_to(x)
    (tmp_path / "__spark_entry__.py").symlink_to(ROOT / "__spark_entry__.py")
    code = "import sys; sys.path[:0] = ['.']; import importlib.util as u; s = u.spec_from_file_location('e', '__spark_entry__.py'); m = u.module_from_spec(s); s.loader.exec_module(m); print(sum(n.startswith('op') or n == 'pipeline' for n in m.queries()), len(m.queries()) > 30)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, capture_output=True, text=True, check=True)
    assert out.stdout.split() == ["0", "True"]
