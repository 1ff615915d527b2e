"""All text operators and the pipeline run where only the driver has this repository on its path."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"

CODE = """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")

def lacks(batches):
    import importlib.util
    for b in batches:
        b["id"] = int(importlib.util.find_spec("hodoscope") is None)
        yield b

assert spark.range(4).mapInPandas(lacks, "id long").agg({"id": "min"}).first()[0] == 1, "workers find the package"
sys.path.insert(0, ROOT)
import __spark_entry__ as e
queries = e.queries()
for name in sorted(n for n in queries if n.startswith("op") or n == "pipeline"):
    print(name, queries[name](spark, DATA).count(), flush=True)
"""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")
def test_workers_need_no_copy_of_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONDONTWRITEBYTECODE": "1"}
    script = tmp_path / "run.py"
    script.write_text(f"ROOT, DATA = {ROOT!r}, {DATA!r}\n{CODE}")
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    assert len(done.stdout.split("\n")) > 13
