"""Where intermediate tables go: a folder the cluster names, and a local one only where there is one machine."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from postmatch.staging import shared_folder


def session(master, checkpoint=None, warehouse=None):
    conf = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse or "file:/driver/spark-warehouse"}
    given = {"spark.sql.warehouse.dir": warehouse}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: conf.get(key) or default),
        sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda key, default=None: given.get(key) or default)),
    )


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]", "local-cluster[3,2,1000]", "spark://host:7077", "yarn"])
def test_named_folders_count_everywhere(master):
    assert shared_folder(session(master, checkpoint="hdfs://x/stage", warehouse="hdfs://x/w")) == "hdfs://x/stage"
    assert shared_folder(session(master, warehouse="hdfs://x/w/")) == "hdfs://x/w/_stage"


@pytest.mark.parametrize("master,fine", [("local", True), ("local[8]", True), ("local-cluster[3,2,1000]", False), ("yarn", False), ("k8s://x", False)])
def test_a_folder_of_the_driver_is_refused_on_a_cluster(master, fine):
    if fine:
        assert shared_folder(session(master)) == "file:/driver/spark-warehouse/_stage"
    else:
        with pytest.raises(RuntimeError):
            shared_folder(session(master))
