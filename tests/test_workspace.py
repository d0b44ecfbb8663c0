"""Where intermediate tables go."""

import os
from types import SimpleNamespace

import pytest

from copycensus import workspace


def session(master, setting=None, set_by_call=None):
    context = SimpleNamespace(master=master, applicationId=f"app-{master}", getCheckpointDir=lambda: set_by_call)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda name, default: setting), sparkContext=context)


def test_shared_folder_is_the_one_the_session_names():
    assert workspace.shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    assert workspace.shared_dir(session("yarn", None, "hdfs:///called")) == "hdfs:///called"


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        workspace.shared_dir(session("yarn"))
    local = workspace.shared_dir(session("local[2]"))
    assert local == workspace.shared_dir(session("local[2]"))
    os.rmdir(local.removeprefix("file:"))


def test_snapshot(spark):
    df = spark.range(10).selectExpr("id", "id % 3 AS kind")
    stored = workspace.snapshot(df, "numbers")
    (path,) = {os.path.dirname(f) for f in stored.inputFiles()}
    assert workspace.shared_dir(spark) in path and "/numbers-" in path
    assert stored.schema.simpleString() == df.schema.simpleString() and stored.count() == 10
    assert workspace.is_committed(spark, path) and not workspace.is_committed(spark, path + "-other")
    workspace.delete(spark, path)
    assert workspace.child_names(spark, path) == []
