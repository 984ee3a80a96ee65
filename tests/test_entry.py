"""What the driver's entry points give when parts of the library are missing."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
BLOCK = "import sys\nfor n in {names!r}: sys.modules[n] = None\nimport __spark_entry__ as e\nq = e.queries()\nassert set(e.oracle_sql()) <= set(q)\nprint(len(q), sum(k.startswith(('p4_', 'p6_', 'p7_', 'p8_', 'p9_', 'p10_')) for k in q))"


def run(*names):
    return subprocess.run([sys.executable, "-W", "ignore", "-c", BLOCK.format(names=names)], cwd=REPO, capture_output=True, text=True)


def test_a_missing_library_of_the_optional_part_leaves_the_rest():
    for name in ("ahocorasick", "tiktoken", "motionlake.llm"):
        n, optional = map(int, run(name).stdout.split())
        assert n >= 60 and optional == 0


def test_a_missing_general_part_is_an_error():
    assert "ImportError" in run("motionlake.plans").stderr or "ModuleNotFoundError" in run("motionlake.plans").stderr
