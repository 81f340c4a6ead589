import pytest

from folioforge import runtime


class _Session:
    """What shared_dir reads of a session."""

    def __init__(self, master, said=None):
        self.conf = self
        self.sparkContext = self
        self.master, self.said = master, said

    def get(self, key, default=None):
        return self.said or default

    def getConf(self):
        return self


def test_shared_folder():
    assert runtime.shared_dir(_Session("yarn", "hdfs://x/shared/")) == "hdfs://x/shared"
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            runtime.shared_dir(_Session(master))
    assert runtime.shared_dir(_Session("local[4]")).startswith("file://")


def test_staged_tables_keep_their_types_and_go(spark):
    import os

    df = spark.range(5).selectExpr("id", "array(id) as a", "cast(null as map<string,string>) as m")
    staged = runtime.stage_table(df, "kept")
    assert staged.schema.simpleString() == df.schema.simpleString() and staged.count() == 5 and runtime.small_enough(staged)
    place = staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(place)
    runtime.drop_staged(spark, staged)
    assert not os.path.isdir(place)
