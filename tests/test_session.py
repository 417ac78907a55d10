"""A real local session that no configuration gives a shared folder."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
PROGRAM = """
from surtscope import session
spark = session.build_session("plain", 1)
assert spark.conf.get("spark.checkpoint.dir", None) is None
one, two = session.run_folder(spark, "x"), session.run_folder(spark, "x")
assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
spark.range(3).write.parquet(one)
print("rows", spark.read.parquet(one).count())
"""


def test_plain_local_session_has_a_folder(tmp_path):
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROGRAM], env=env, capture_output=True, text=True, timeout=300)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
