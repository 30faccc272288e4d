"""Rows that scans read from each source file, from Spark's event log of another process."""

import json
import os
import subprocess
import sys
import tempfile
from collections import Counter

HEAD = """
import sys
sys.path.insert(0, {repo!r})
from faultbench.session import build_session
spark = build_session("local[2]", shuffle_partitions=4, extra={{
    "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{folder}", "spark.eventLog.rolling.enabled": "false",
    "spark.eventLog.compress": "false", "spark.checkpoint.dir": {folder!r} + "/checkpoints",
    "spark.sql.warehouse.dir": {folder!r} + "/warehouse"}})
def counted():
    spark.sparkContext.setJobDescription("counted")
"""


def _nodes(plan):
    yield plan
    for child in plan.get("children", []):
        yield from _nodes(child)


def rows_read(code: str, source: str) -> Counter:
    """Run ``code`` with a session ``spark``; rows read from files under ``source`` after ``counted()``."""
    folder = tempfile.mkdtemp(prefix="fb-events-")
    os.mkdir(f"{folder}/log")
    head = HEAD.format(repo=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), folder=folder).replace(
        f"file://{folder}", f"file://{folder}/log"
    )
    subprocess.run([sys.executable, "-c", head + code + "\nspark.stop()\n"], check=True, timeout=600, capture_output=True)
    (name,) = os.listdir(f"{folder}/log")
    table, counts, wanted = {}, Counter(), set()
    with open(f"{folder}/log/{name}") as log:
        for line in log:
            event = json.loads(line)
            kind = event["Event"].rsplit(".", 1)[-1]
            if kind == "SparkListenerSQLExecutionStart" and event.get("description") == "counted":
                wanted.add(event["executionId"])
            if kind in ("SparkListenerSQLExecutionStart", "SparkListenerSQLAdaptiveExecutionUpdate") and event["executionId"] in wanted:
                for node in _nodes(event["sparkPlanInfo"]):
                    place = node["metadata"].get("Location", "")
                    if source in place:
                        for metric in node["metrics"]:
                            if metric["name"] == "number of output rows":
                                table[metric["accumulatorId"]] = place.split(source)[1].split("/")[1].split(".")[0]
            if kind == "SparkListenerTaskEnd":
                for a in event["Task Info"]["Accumulables"]:
                    if "Update" in a and a["ID"] in table:
                        counts[table[a["ID"]]] += int(a["Update"])
    return counts
