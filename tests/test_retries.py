"""Jobs survive lost tasks: results with injected first-attempt failures equal a clean run."""

import json
import os
import subprocess
import sys

from tests.conftest import SF_SMALL


def test_results_survive_task_retries():
    script = os.path.join(os.path.dirname(__file__), "retry_probe.py")
    proc = subprocess.run([sys.executable, script, SF_SMALL], capture_output=True, text=True, timeout=900)
    lines = [ln for ln in proc.stdout.splitlines() if ln.startswith("{")]
    assert lines, proc.stderr[-3000:]
    res = json.loads(lines[-1])
    assert res["equal"], res
    assert all(v > 0 for v in res["sizes"].values())
