from types import SimpleNamespace

import pytest

from affectframe.session import new_dir, shared_dir


class _Context:
    def __init__(self, master):
        self.master, self.folder = master, None

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def _session(master, configured=None):
    conf = SimpleNamespace(get=lambda key, default=None: configured or default)
    return SimpleNamespace(conf=conf, sparkContext=_Context(master))


def test_the_configured_folder_is_used():
    session = _session("yarn", "hdfs://shared/work/")
    assert shared_dir(session) == "hdfs://shared/work"
    assert new_dir(session, "model").startswith("hdfs://shared/work/model-")
    assert session.sparkContext.folder is None


def test_a_folder_of_our_own_in_local_mode_only():
    session = _session("local[2]")
    assert shared_dir(session) == shared_dir(session) == session.sparkContext.folder
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(_session("spark://host:7077"))
