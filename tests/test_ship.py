"""Python functions find the package however the driver was started."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from floodstats.functions.special import normal_cdf
assert spark.sql("SELECT 0D AS x").select(normal_cdf("x")).first()[0] == 0.5
"""


def test_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))}
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert done.returncode == 0, done.stderr[-2000:]
