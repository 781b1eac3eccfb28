from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lexweave.session import ship_package
from lexweave.sources import tables
from tests.conftest import rows


def test_stage_and_spread(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.rand(1))
    staged = tables.stage(df, "numbers")
    assert rows(staged) == rows(df) and all("lexweave" in f or "numbers" in f for f in staged.inputFiles())
    small = spark.range(0, 100, 1, 1)
    cores = spark.sparkContext.defaultParallelism
    assert tables.spread(small).rdd.getNumPartitions() == cores and rows(tables.spread(small)) == rows(small)
    large = spark.range(0, 100, 1, cores + 3)
    assert tables.spread(large).rdd.getNumPartitions() == cores + 3


def session(folder, master):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder if folder and key == "spark.checkpoint.dir" else default), sparkContext=SimpleNamespace(applicationId="app-1", master=master))


def test_shared_folder_is_the_one_the_session_names(spark):
    assert tables.shared_dir(session("hdfs://cluster/shared/", "spark://host:7077")) == "hdfs://cluster/shared/lexweave-app-1"
    unnamed = session(None, "local[4]")
    assert tables.shared_dir(unnamed).startswith("file:///") and tables.shared_dir(unnamed) == tables.shared_dir(unnamed)


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_no_local_folder_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        tables.shared_dir(session(None, master))


def test_staged_tables_are_removed(spark, tmp_path):
    folder = tmp_path / "own"
    folder.mkdir()
    (folder / "part").write_text("x")
    tables._remove(spark, f"file://{folder}")
    assert not folder.exists()
    tables._remove(SimpleNamespace(), "file:///nowhere")


def test_package_reaches_the_workers(spark):
    ship_package(spark)
    ship_package(spark)

    @F.udf("string")
    def where(_):
        import lexweave

        return lexweave.__name__

    assert spark.range(1).select(where("id").alias("w")).first()["w"] == "lexweave"
