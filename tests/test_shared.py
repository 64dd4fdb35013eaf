import pytest

from skydrift.sources import shared


def test_addresses_are_whole(spark, tmp_path, monkeypatch):
    """A folder without a scheme lies where Spark looks for it, wherever the default file system is."""
    at = shared.full_address(spark, str(tmp_path / "x"))
    assert at == f"file:{tmp_path}/x"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", f"viewfs://here/")
    conf.set("fs.viewfs.mounttable.here.link./data", f"file://{tmp_path}")
    try:
        assert shared.full_address(spark, "/data/x") == "viewfs://here/data/x"
        assert shared.full_address(spark, f"file://{tmp_path}/x") == f"file:{tmp_path}/x"
    finally:
        conf.set("fs.defaultFS", before) if before else conf.unset("fs.defaultFS")


def test_kept_tables_are_apart(spark):
    a, b = (shared.kept(spark.range(n), "t") for n in (2, 3))
    assert (a.count(), b.count()) == (2, 3)
    assert shared.new_folder(spark, "t") != shared.new_folder(spark, "t")
    assert shared.kept(spark.range(0), "none").columns == ["id"]


def test_a_cluster_has_to_name_a_folder(monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
