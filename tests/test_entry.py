"""The entry module without the optional subpackage, or without what that imports."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.modules[{missing!r}] = None
import __spark_entry__ as e
names = set(e.queries())
assert not any(n.startswith("op") and n[2].isdigit() for n in names) and "pipeline" not in names
assert "motif_labels" in names and set(e.oracle_sql()) <= names
"""


def test_queries_without_the_subpackage():
    for missing in ("streamlanes.llm", "xxhash"):
        subprocess.run([sys.executable, "-c", CODE.format(missing=missing)], cwd=ROOT, check=True, timeout=60)
