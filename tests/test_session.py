from __future__ import annotations

from types import SimpleNamespace

import pytest

from codeloom.session import shared_dir


def session(master, folder=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda _, default: folder or default), sparkContext=SimpleNamespace(master=master))


def test_a_cluster_needs_a_shared_folder():
    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
        assert shared_dir(session(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert shared_dir(session("local[4]")).startswith("file:///")
