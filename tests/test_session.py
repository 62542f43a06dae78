import os
import subprocess
import sys

from pyspark.sql import functions as F

from weftline import session

ALONE = """
import os, sys
sys.path.insert(0, {home!r})
from weftline import session
s = session.local_session("1", 1)
assert not s.sparkContext.getConf().get("spark.checkpoint.dir", None)
t = session.written(s.range(5), "t")
assert t.count() == 5 and session.shared_folder(s) == session.shared_folder(s)
print("FOLDER", session.shared_folder(s))
"""


def test_saved_tables_without_a_set_folder(tmp_path):
    home = os.path.dirname(os.path.dirname(os.path.abspath(session.__file__)))
    empty = tmp_path / "conf"
    empty.mkdir()
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_SUBMIT"))} | {"SPARK_CONF_DIR": str(empty)}
    ran = subprocess.run([sys.executable, "-c", ALONE.format(home=home)], capture_output=True, text=True, env=env, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    folder = next(x.split()[1] for x in ran.stdout.splitlines() if x.startswith("FOLDER"))
    assert not os.path.exists(folder)


def test_saved_tables_are_merged_and_discarded(spark):
    a = session.written(spark.range(100).withColumn("x", F.col("id") % 7), "a")
    plan = a.join(session.written(spark.range(3), "b").groupBy("id").count(), "id")._jdf.queryExecution().toString()
    assert "Broadcast" not in plan
    path = a._weftline_path.removeprefix("file://")
    assert os.path.isdir(path)
    session.discard(a)
    assert not os.path.exists(path)
