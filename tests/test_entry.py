"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 90
    assert e.entry(spark).limit(1).count() == 1


def test_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "bench.py", "roadgeo"):
        src = ROOT / name
        subprocess.run(["cp", "-r", str(src), str(tmp_path / name)], check=True)
    shutil.rmtree(tmp_path / "roadgeo/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; assert 'section_scores' in e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_names_the_optional_parts():
    for path in [*ROOT.glob("roadgeo/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts and path.name != "test_entry.py":
            text = path.read_text()
            assert "roadgeo.llm" not in text and "from .llm" not in text and "import corpus_pipeline" not in text, path
