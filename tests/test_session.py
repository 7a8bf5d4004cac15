from types import SimpleNamespace

import pytest

from pagesift import session


class Settings(dict):
    pass


def fake(master, **named):
    """A session of which only the shared folder's settings are asked."""
    context = SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda folder: None
    )
    return SimpleNamespace(conf=Settings(named), sparkContext=context)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://x", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake(master))
    assert session.shared_folder(fake(master, **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_gets_a_temporary_folder(master):
    assert session.shared_folder(fake(master)).startswith("/")
