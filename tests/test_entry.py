"""The driver contract, with and without the optional subpackage."""

import subprocess
import sys
import shutil

from conftest import ROOT


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["query_id", "chunk_id", "pos", "score", "rank"] and df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_without_the_optional_subpackage(tmp_path):
    ignore = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "granary", tmp_path / "granary", ignore=ignore)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
