import types

import pytest

from docweave.session import shared_dir


def session(master, conf=None, folder=None):
    """Stands for a session; no cluster is at hand in tests."""
    context = types.SimpleNamespace(master=master, folder=folder)
    context.getCheckpointDir = lambda: context.folder
    context.setCheckpointDir = lambda path: setattr(context, "folder", f"{path}/own")
    return types.SimpleNamespace(sparkContext=context, conf=types.SimpleNamespace(get=lambda name, other: conf))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://host", "local-cluster[3,2,1024]"])
def test_a_cluster_names_its_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session(master))
    assert shared_dir(session(master, conf="hdfs:/shared")) == "hdfs:/shared"
    assert shared_dir(session(master, folder="hdfs:/set")) == "hdfs:/set"


@pytest.mark.parametrize("master", ["local", "local[8]", "local[*]"])
def test_one_machine_takes_a_temporary_folder_once(master):
    one = session(master)
    first = shared_dir(one)
    assert first.endswith("/own") and shared_dir(one) == first
