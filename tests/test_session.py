"""Where intermediate tables go."""

import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from barline.session import checkpoint_root


def session(master, conf=(), context_dir=None):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: context_dir, applicationId=f"app-{master}")
    return SimpleNamespace(sparkContext=context, conf=dict(conf))


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_names_its_folder(master):
    with pytest.raises(RuntimeError):
        checkpoint_root(session(master))
    assert checkpoint_root(session(master, {"spark.checkpoint.dir": "hdfs:/x"})) == "hdfs:/x"
    assert checkpoint_root(session(master, context_dir="hdfs:/y/z")) == "hdfs:/y/z"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]", "local[4,2]"])
def test_one_machine_makes_a_folder_once(master):
    spark = session(master)
    assert checkpoint_root(spark) == checkpoint_root(spark)


def test_a_real_session_without_the_setting(tmp_path):
    code = (
        "from barline.session import local_session, materialize; s = local_session(1);"
        "assert s.conf.get('spark.checkpoint.dir', None) is None; print('rows', materialize(s.range(3), 'x').count())"
    )
    done = subprocess.run(
        [sys.executable, "-c", code],
        capture_output=True,
        text=True,
        timeout=120,
        env=os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()},
    )
    assert "rows 3" in done.stdout, done.stderr[-2000:]
