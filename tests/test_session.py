"""Scratch tables: where they may lie, and that they can be removed."""

import os
from types import SimpleNamespace

import pytest

from quire.session import clear_scratch, materialize, shared_dir


def test_a_cluster_names_its_shared_folder():
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_scratch_is_removed(spark):
    table = materialize(spark.range(3), "own")
    folder = table.inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.isdir(folder) and table.count() == 3
    clear_scratch(spark)
    assert not os.path.exists(folder)
