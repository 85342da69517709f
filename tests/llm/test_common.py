import os

import pytest

from lexloom.llm import common


class Cluster:
    """A session of a cluster without a shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return {"spark.master": "yarn"}.get(key, default)


def test_no_local_folder_on_a_cluster():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_written_tables_go(spark):
    a, b = common.materialize(spark.range(5), "test"), common.materialize(spark.range(3), "test")
    assert a.count() == 5 and os.path.isdir(a._written) and a._written.startswith(common.shared_dir(spark))
    common.discard(a, spark.range(2))
    assert not os.path.exists(a._written) and b.count() == 3
