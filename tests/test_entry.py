import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    df = entry.entry(spark)
    assert df.columns == ["k", "seq", "v"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_training_data_part(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and all(n.startswith('kv_') for n in (*q, *e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, check=True)
    for path in (tmp_path / "tidemark").rglob("*.py"):
        assert "tidemark.llm" not in path.read_text()
