from types import SimpleNamespace

import pytest

from seapoint.llm.staging import shared_folder


def _session(master, **settings):
    conf = SimpleNamespace(get=settings.get, set=settings.__setitem__)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(_session("spark://host:7077"))
    named = {"spark.checkpoint.dir": "hdfs://host/shared/"}
    assert shared_folder(_session("spark://host:7077", **named)) == "hdfs://host/shared"


def test_one_local_folder_for_a_session():
    session = _session("local[2]")
    assert shared_folder(session).startswith("file://") and shared_folder(session) == shared_folder(session)
