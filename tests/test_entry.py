"""The driver contract, and independence of the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    assert entry.entry(spark).columns == ["page_id", "link", "score", "rank"]
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) >= 100


def test_library_stands_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "quarrymill"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else None
    copy = tmp_path / "quarrymill"
    copy.mkdir()
    for part in (ROOT / "quarrymill").iterdir():
        if part.name not in ("llm", "__pycache__"):
            (copy / part.name).symlink_to(part)
    code = "import __spark_entry__ as e; assert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}, timeout=120)
