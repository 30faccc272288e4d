"""Bytes that a piece of code writes to shuffles, from Spark's event log of another process."""

import json
import os
import subprocess
import sys
import tempfile

from tests.scans import HEAD


def bytes_shuffled(code: str) -> int:
    """Run ``code`` with a session ``spark``; the bytes that its tasks wrote to shuffles."""
    folder = tempfile.mkdtemp(prefix="fb-events-")
    os.mkdir(f"{folder}/log")
    head = HEAD.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=folder).replace(
        f"file://{folder}", f"file://{folder}/log"
    )
    subprocess.run([sys.executable, "-c", head + code + "\nspark.stop()\n"], check=True, timeout=600, capture_output=True)
    (name,) = os.listdir(f"{folder}/log")
    with open(f"{folder}/log/{name}") as log:
        ends = [json.loads(line) for line in log if '"Event":"SparkListenerTaskEnd"' in line]
    return sum(e["Task Metrics"]["Shuffle Write Metrics"]["Shuffle Bytes Written"] for e in ends)
