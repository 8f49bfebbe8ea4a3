import os

import pytest

from helixframe import runtime


def test_tables_survive_and_can_be_released(spark):
    t = runtime.Table(spark.range(5), "x")
    assert t.df.count() == 5 and t.path.startswith(runtime.shared_folder(spark))
    t.drop()
    assert not os.path.exists(t.path)
    kept = runtime.materialize(spark.range(3).where("id > 7"))
    assert kept.count() == 0 and kept.columns == ["id"]
    runtime.release(spark)
    assert not os.path.exists(runtime.shared_folder(spark))
    assert runtime.materialize(spark.range(2)).count() == 2


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        applicationId, master = "app-x", "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        runtime.shared_folder(Session())
