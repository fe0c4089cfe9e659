"""Jobs with Python workers, started from a folder that is not the repository."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as entry_points
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
for name in ("img2_resample", "src1_sqlite_scan"):
    print(name, entry_points.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_need_no_installed_package(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=300
    )
    assert "img2_resample 500" in done.stdout, done.stderr[-3000:]
    assert "src1_sqlite_scan 1500" in done.stdout, done.stderr[-3000:]
