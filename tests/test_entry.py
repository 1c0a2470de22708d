"""The driver's contract, with and without the optional subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_parts(tmp_path):
    for name in ("tidemark", "__spark_entry__.py"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "tidemark" / "llm", ignore_errors=True)
    script = (
        "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql(); "
        "from tidemark.session import get_spark; s = get_spark('alone', 'local[2]', spark__ui__enabled='false'); assert q['bars_daily'](s, '/root/testdata/sf0.001').count() > 0; s.stop()"
    )
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, check=True)


def test_a_broken_core_import_does_not_hide_there(tmp_path):
    for name in ("tidemark", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.exists(source):
            (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    if not (tmp_path / "corpus_pipeline.py").exists():
        return
    os.remove(tmp_path / "tidemark" / "operators" / "components.py")
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert found.returncode and "tidemark.operators.components" in found.stderr
