"""Python workers run the package's functions without having the package."""

import os
import subprocess
import sys
import textwrap


def test_workers_do_not_import_the_package(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = textwrap.dedent(
        f"""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        import __spark_entry__ as e
        for n in ("win_14_strict_rank", "win_15_ewm", "str_07_positions_batch", "str_09_ewma", "udf_01_arrow_feature"):
            e.queries()[n](s, "/root/testdata/sf0.001").collect()
        print("shipped")
        """
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "shipped" in out.stdout, out.stderr[-2000:]
