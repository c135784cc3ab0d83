"""Tables that cut a plan: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a file of a small table.
FILE_ROWS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; a temporary one in local mode only."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="mnemospark-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, and a lost executor costs nothing that was written.

    The table goes when the application ends. ``rows``: about how many rows the table has; then so few of them do not
    become a file for each shuffle partition.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(1 + rows // FILE_ROWS)).write.parquet(path)
    drop_folder(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str, at_exit: bool = False) -> None:
    """Delete a folder of the shared store, now or when the application ends."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if at_exit:
        store.deleteOnExit(folder)
    else:
        store.delete(folder, True)
