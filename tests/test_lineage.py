"""Intermediate tables: where they are written, and when they go."""

import os
from types import SimpleNamespace

import pytest

from lodestar.plans import lineage


def session(master, folder=None):
    conf = SimpleNamespace(get=lambda key, default=None: folder)
    sc = SimpleNamespace(master=master, applicationId=f"app-{master}", getConf=lambda: SimpleNamespace(get=lambda key: None), getCheckpointDir=lambda: None)
    return SimpleNamespace(conf=conf, sparkContext=sc)


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        lineage.shared_folder(session("spark://host:7077"))
    assert lineage.shared_folder(session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert os.path.isdir(lineage.shared_folder(session("local[2]")))


def test_written_tables_are_read_back_and_discarded(spark):
    df = lineage.written(spark.range(5).toDF("x"), "numbers")
    path = getattr(df, lineage._paths)
    assert sorted(r[0] for r in df.collect()) == [0, 1, 2, 3, 4]
    assert os.path.isdir(path.removeprefix("file:"))
    lineage.discard(df, None, spark.range(3))
    assert not os.path.isdir(path.removeprefix("file:"))
