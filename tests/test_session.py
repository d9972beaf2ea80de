"""Where intermediate tables go."""

import pytest

from fairlend.plans import session


class _Context:
    def __init__(self, master):
        self.master = master

    def getCheckpointDir(self):
        return None

    def setCheckpointDir(self, path):
        raise AssertionError("no folder may be registered")


class _Conf:
    def get(self, key, default=None):
        return default


class _Session:
    conf = _Conf()

    def __init__(self, master):
        self.sparkContext = _Context(master)


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "k8s://host", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_raises(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(_Session(master))


def test_local_masters():
    assert session.is_local("local") and session.is_local("local[*]") and not session.is_local("local-cluster[1,1,1]")
