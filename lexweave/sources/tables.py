"""Table access and staged tables.

``table`` reads one named parquet table of a data directory.  ``stage`` cuts
lineage: it writes a DataFrame as parquet into the shared folder named by
``spark.checkpoint.dir`` and reads it back, so a lost executor costs a re-read
and never a recomputation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_removed_at_exit: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``sf_dir`` (a file or a folder of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many tasks as there are cores.

    Only a scan with fewer splits than cores – a small table – is redistributed;
    a large one is left as it is, so nothing is shuffled at scale.  For work that
    costs far more per row than a small table's shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def heavy_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A table for work that is heavy per row, spread over the cores."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


def shared_dir(spark: SparkSession) -> str:
    """The folder of this application in the folder all executors share; it is removed when the driver ends.

    Where ``spark.checkpoint.dir`` is unset a local folder is made, on a local
    master only; on a cluster that is an error.
    """
    global _own_dir
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        own = f"{set_dir.rstrip('/')}/lexweave-{spark.sparkContext.applicationId}"
        if own not in _removed_at_exit:
            _removed_at_exit.add(own)
            atexit.register(_remove, spark, own)
        return own
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return f"file://{_own_dir}"


def _remove(spark: SparkSession, path: str) -> None:
    """Staged tables are of use to one application only; one that has ended by itself keeps them."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session is gone, and with it the way to the folder
        pass


def stage(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder (zstd parquet) and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
