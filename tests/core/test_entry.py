import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]
CODE = """
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names and "flagship_report" in names
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
"""


def test_works_without_the_corpus_operators(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "millrace"):
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for again in range(2):  # with the pipeline's file, then without it
        subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True, timeout=120)
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
