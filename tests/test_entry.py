import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parents[1]
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
