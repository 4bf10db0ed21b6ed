"""Session helpers: checkpoint folder rules, settings application, materialisation."""

from types import SimpleNamespace

import pytest

from clickflow.plans.materialize import materialize
from clickflow.session import apply_missing, ensure_checkpoint_dir


class _Conf(dict):
    def get(self, k, default=None):
        return super().get(k, default)

    def set(self, k, v):
        self[k] = v


def _fake_session(master, conf_dir=None):
    sc = SimpleNamespace(
        master=master,
        getCheckpointDir=lambda: None,
        getConf=lambda: _Conf(),
        setCheckpointDir=lambda d: None,
    )
    conf = _Conf({"spark.checkpoint.dir": conf_dir} if conf_dir else {})
    return SimpleNamespace(sparkContext=sc, conf=conf)


def test_cluster_without_shared_checkpoint_folder_is_refused():
    with pytest.raises(ValueError, match="shared folder"):
        ensure_checkpoint_dir(_fake_session("yarn"))


def test_cluster_with_configured_folder_uses_it():
    assert ensure_checkpoint_dir(_fake_session("yarn", "hdfs:///shared/ckpt")) == "hdfs:///shared/ckpt"


def test_local_without_folder_gets_a_local_one():
    assert ensure_checkpoint_dir(_fake_session("local[2]")).startswith("/")


def test_apply_missing_keeps_set_values():
    conf = _Conf({"a": "1"})
    apply_missing(conf, {"a": "2", "b": "3"})
    assert conf == {"a": "1", "b": "3"}


def test_materialize_rejects_unknown_method(spark):
    with pytest.raises(ValueError, match="unknown materialisation"):
        materialize(spark.range(3), how="cache")
    assert materialize(spark.range(3), enabled=False).count() == 3
    assert sorted(r[0] for r in materialize(spark.range(3)).collect()) == [0, 1, 2]
    assert sorted(r[0] for r in materialize(spark.range(3), how="checkpoint").collect()) == [0, 1, 2]
