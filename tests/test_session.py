from __future__ import annotations

from types import SimpleNamespace

import pytest

from seqwatch import session


def test_scratch_is_below_the_configured_folder(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    one, two = session.scratch_path(spark, "x"), session.scratch_path(spark, "x")
    assert configured in one and one != two


class FakeContext:
    def __init__(self, master):
        self.master, self.dir = master, None

    def getCheckpointDir(self):
        return self.dir

    def setCheckpointDir(self, path):
        self.dir = path


def fake(master, conf):
    return SimpleNamespace(
        sparkContext=FakeContext(master), conf=SimpleNamespace(get=lambda k, d=None: conf.get(k, d))
    )


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(fake("spark://host:7077", {}))
    shared = fake("spark://host:7077", {"spark.checkpoint.dir": "hdfs://shared/x"})
    assert session.ensure_checkpoint_dir(shared) == "hdfs://shared/x"


def test_a_local_session_may_use_a_temporary_folder():
    assert session.ensure_checkpoint_dir(fake("local[2]", {}))
