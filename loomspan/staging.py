"""Tables between steps, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors reach.

    Where the setting is absent, a session on one machine (as in tests) gets a
    temporary folder. On a cluster that is an error: each executor would write
    to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomspan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, which goes at interpreter exit with all that it holds."""
    path = f"{shared_folder(spark)}/loomspan-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df as Parquet below the shared folder, in partitions by the columns `by`, and read it back.

    This cuts the lineage, survives lost executors and keeps later branches
    from running the same work twice. Folders go at interpreter exit.
    """
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove_written() -> None:
    for spark, path in _made:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001, S112  one folder or session that is gone mustn't keep the others
            continue
