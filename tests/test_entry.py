import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_stands_without_the_llm_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lattica" / "llm" / "__pycache__").mkdir(parents=True)
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') and n[2].isdigit()]; assert 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)


def test_entry(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        r = e.entry(spark).first()
        assert r.n_parts == 200 and r.max_change > 0


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(f"{ROOT}/lattica"):
        if "/llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                with open(f"{folder}/{f}") as h:
                    assert "llm" not in h.read()
