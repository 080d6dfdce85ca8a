"""Written intermediates in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Deletes a job's shuffle files when the job has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only on one machine (a local master, as
    in tests) a temporary folder is made where that is unset, and set; elsewhere each executor would
    write to a disk of its own, so an unset folder is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        ours = spark.sparkContext._jsc.sc().getCheckpointDir()
        if ours.isDefined():
            found = ours.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = f"file://{tempfile.mkdtemp(prefix='claimloom-')}"
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended: the folder's owner clears it
        pass


@contextmanager
def setting(spark: SparkSession, **values):
    """Session settings that hold inside the block only; names are given with "__" for "."."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """`df`, written as Parquet in the shared folder and read again: lineage ends here.

    Losing an executor later costs a read, never a recomputation. Shuffle files of the job go when it
    has ended. What `dropped` has not deleted goes when the driver ends; what a killed driver leaves
    lies in one folder named after its application.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"claimloom-{spark.sparkContext.applicationId}", f"{name}-{uuid.uuid4().hex}")
    out = df.write if codec is None else df.write.option("compression", codec)
    with setting(spark, **{_CLEANUP.replace(".", "__"): "true"}):
        out.parquet(path)
    atexit.register(delete, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back._written = path
    return back


#: Bytes of files read for each partition of `spread`.
SHARE = 4 << 20


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """`df` by hash of `keys` in as many parts as its input has shares, so that a task's part does not
    grow with the input. At least as many as the session's shuffles have."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(n for n in sizes if n < 1 << 50)  # rows of the driver have no known size
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(read // SHARE, 10_000)), *keys)


def dropped(*tables: DataFrame) -> None:
    """Deletes `written` tables from which everything that is still needed has itself been written."""
    for t in tables:
        delete(t.sparkSession, t._written)
