"""The entry point works with and without the llm subpackage, and what it names fits together."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert not set(e.oracle_sql()) - set(e.queries())


def test_imports_without_llm(tmp_path):
    for p in REPO.iterdir():
        if p.name not in ("textloom", "corpus_pipeline.py", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "textloom").mkdir()
    for p in (REPO / "textloom").iterdir():
        if p.name != "llm":
            (tmp_path / "textloom" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})


def test_flagship(spark):
    from textloom import registry

    rows = registry.QUERIES["protected_inventory_by_language"](spark, "/root/testdata/sf0.001")
    assert rows.columns == ["lang", "kind", "n"] and rows.count() > 0
