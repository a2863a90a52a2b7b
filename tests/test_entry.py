import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

REPO = Path(__file__).resolve().parent.parent


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_operators(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("textloom", "corpus_pipeline.py", ".git", "tests"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "textloom").mkdir()
    for p in (REPO / "textloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            (tmp_path / "textloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lines_hashed' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_flagship(spark):
    got = entry.entry(spark)
    assert got.columns == ["doc_id", "line_no", "text", "total", "truncated", "hash", "anchor"]
    assert got.count() > 0
