"""Folders, and files that tasks read."""

from types import SimpleNamespace

import pytest

from sievework.sources import shared, ship


def test_a_cluster_needs_a_shared_folder():
    def session(master, named):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: named), sparkContext=SimpleNamespace(master=master))

    assert shared.shared_folder(session("spark://a:7077", "hdfs:///c")) == "hdfs:///c"
    assert shared.shared_folder(session("local[4]", None)).startswith("/")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(session("yarn", None))


def test_tasks_read_their_copy(spark, tmp_path):
    ship.ship(spark)
    f = tmp_path / "words.txt"
    f.write_text("a b c")
    ship.ship_file(str(f))
    ship.ship_file(str(f))

    def read(batches):
        import pandas as pd

        from sievework.sources.ship import local_file

        where = local_file(str(f))
        yield pd.DataFrame({"t": [open(where).read()], "own": [where != str(f)]})

    assert [tuple(r) for r in spark.range(1).coalesce(1).mapInPandas(read, "t string, own boolean").collect()] == [("a b c", True)]
    assert ship.local_file("/no/such/file") == "/no/such/file"
