"""The rest works without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
LISTED = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), len(e.oracle_sql()))"


def test_queries_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "lodestar", tmp_path / "lodestar", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__") and Path(d).name == "lodestar"])
    for pipeline in (False, True):  # the pipeline's file alone is not enough to register it
        shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
        if pipeline and (ROOT / "corpus_pipeline.py").exists():
            shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
        done = subprocess.run([sys.executable, "-c", LISTED], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
        assert done.returncode == 0, done.stderr
        total, trained, oracles = map(int, done.stdout.split())
        assert total > 100 and trained == 0 and oracles > 100


def test_queries_without_a_module_they_need(tmp_path):
    """A missing package costs the queries that need it, and says so."""
    code = "import sys; sys.modules['xxhash'] = None; " + LISTED
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin"})
    assert done.returncode == 0, done.stderr
    total, trained, _ = map(int, done.stdout.split())
    assert total > 100 and trained == 0
    assert not (ROOT / "lodestar" / "llm").exists() or "xxhash" in done.stderr
