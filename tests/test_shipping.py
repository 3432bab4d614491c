"""Task functions run on workers that cannot import this package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import functions as F
from attest.functions.network import in_cidr
from attest.queries import QUERIES
from attest.session import local_session
spark = local_session("shipping")
for name in ("rate_limit", "stream_rate_limit", "stream_flow_state", "stream_session_state"):
    assert QUERIES[name].run(spark, {folder!r}).count() > 0, name
wide = spark.createDataFrame([("2001:db8::1",), ("::1",)], "a string").where(in_cidr("a", ["2001:db8::/32"]))
assert wide.count() == 1
print("shipped")
"""


def test_workers_need_no_installed_package(tmp_path, sf_dir):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    program = PROGRAM.format(root=ROOT, folder=sf_dir)
    done = subprocess.run([sys.executable, "-c", program], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("shipped"), done.stderr[-2000:]
