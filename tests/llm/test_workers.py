"""The operators run where workers have no copy of the package."""

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from tessella.session import get_session
spark = get_session("workers", "local[4]", spark__sql__shuffle__partitions="4")
spark.sparkContext.setLogLevel("ERROR")
from tessella.llm import catalog
for name in sys.argv[2:]:
    print(name, catalog.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_without_the_package_on_workers(tmp_path):
    """Only the driver's own path holds the package, and workers start in another folder."""
    names = ["op2_simhash", "op3_toxicity", "op7_lm_score", "op8_ann", "op11_whiten", "op12_jaccard", "op13_trie"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    (tmp_path / "run.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, "run.py", str(REPO), *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines()] == names
