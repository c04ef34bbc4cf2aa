import os
from types import SimpleNamespace

from quillpress.llm import shared


def test_tables_go_when_they_are_not_needed(spark):
    first = shared.written()
    made = [shared.materialize(spark.range(3), "test") for _ in range(3)]
    paths = [x[1].removeprefix("file://") for x in shared._WRITTEN[first:]]
    shared.forget(first, keep=1)
    shared.tidy(spark)
    assert [os.path.exists(x) for x in paths] == [False, False, True] and shared.written() == first + 1
    assert made[2].count() == 3
    shared.forget(first)
    assert not os.path.exists(paths[2]) and shared.written() == first


def test_folder():
    """The named folder; else the warehouse on a cluster, a folder of our own only where the executors are this process."""

    def session(master, named=None):
        conf = {"spark.sql.warehouse.dir": "hdfs://warehouse/"} | ({"spark.checkpoint.dir": named} if named else {})
        return SimpleNamespace(sparkContext=SimpleNamespace(master=master), conf=SimpleNamespace(get=lambda name, *default: conf.get(name, *default)))

    assert shared.work_dir(session("spark://host:7077", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert shared.work_dir(session("local[4]", "hdfs://shared/x/")) == "hdfs://shared/x"
    assert shared.work_dir(session("spark://host:7077")) == "hdfs://warehouse/quillpress-work"
    assert shared.work_dir(session("local[4]")).startswith("file://")
