from types import SimpleNamespace

import pytest

from obsframe import session


def fake(folder, master, set_dir=None):
    option = SimpleNamespace(isDefined=lambda: set_dir is not None, get=lambda: set_dir)
    context = SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: option)))
    conf = {"spark.checkpoint.dir": folder} if folder else {}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d), set=conf.__setitem__), sparkContext=context)


def test_the_shared_folder_is_used():
    assert session.work_dir(fake("hdfs://x/shared/", "yarn"), "a").startswith("hdfs://x/shared/a-")
    assert session.work_dir(fake(None, "yarn", "hdfs://x/set"), "a").startswith("hdfs://x/set/a-")


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError):
        session.work_dir(fake(None, "spark://host:7077"), "a")


def test_a_local_session_may_have_its_own():
    local = fake(None, "local[2]")
    first, second = session.work_dir(local, "a"), session.work_dir(local, "a")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]
