"""Session helpers: checkpoint folder policy and partition sizing."""

import pytest

from tollgate.session import cluster_conf, ensure_checkpoint_dir, shuffle_partitions_for


class _Conf:
    def __init__(self, values):
        self.values = values

    def get(self, key, default=None):
        return self.values.get(key, default)


class _Context:
    def __init__(self, master, ckpt=None):
        self.master, self._ckpt, self.set_to = master, ckpt, None

    def getCheckpointDir(self):
        return self._ckpt

    def getConf(self):
        return _Conf({})

    def setCheckpointDir(self, d):
        self.set_to = d
        self._ckpt = d


class _Session:
    def __init__(self, master, conf=None, ckpt=None):
        self.sparkContext = _Context(master, ckpt)
        self.conf = _Conf(conf or {})


def test_cluster_without_checkpoint_dir_is_refused():
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(_Session("spark://cluster:7077"))


def test_configured_checkpoint_dir_is_used():
    s = _Session("yarn", conf={"spark.checkpoint.dir": "hdfs:///shared/ckpt"})
    assert ensure_checkpoint_dir(s) == "hdfs:///shared/ckpt"
    assert ensure_checkpoint_dir(_Session("yarn", ckpt="hdfs:///already")) == "hdfs:///already"


def test_local_session_gets_a_scratch_folder():
    s = _Session("local[2]")
    d = ensure_checkpoint_dir(s)
    assert d and d.startswith("/") and s.sparkContext.set_to == d


def test_partitions_sized_from_bytes():
    assert shuffle_partitions_for(10 * 1024 ** 4) == 10240
    assert shuffle_partitions_for(100 * 1024 ** 4) == 50_000
    assert shuffle_partitions_for(1) == 1


def test_partitions_of_small_large_and_streaming_jobs():
    key = "spark.sql.shuffle.partitions"
    assert cluster_conf(5 * 1024 ** 3)[key] == "200"
    assert cluster_conf(3 * 1024 ** 4)[key] == "3072"
    assert cluster_conf(100 * 1024 ** 4, streaming=True)[key] == "1000"
    assert cluster_conf()["spark.sql.ansi.enabled"] == "true"
