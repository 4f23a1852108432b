"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "lifeloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; explicit settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Where it is unset, a session in one process makes one of its own; a cluster has to name it.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root and (held := sc._jsc.sc().getCheckpointDir()).isDefined():
        root = held.get()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lifeloom-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[tuple] = []


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the program ends."""
    path = f"{shared_folder(spark)}/lifeloom/{name}-{uuid.uuid4().hex}"
    _made.append((weakref.ref(spark), path))
    return path


def delete_folder(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    _made[:] = [m for m in _made if m[1] != path]


@atexit.register
def _clean() -> None:
    for ref, path in list(_made):
        spark = ref()
        try:
            if spark is not None and spark.sparkContext._jsc is not None:
                delete_folder(spark, path)
        except Exception:  # the session has ended; its folder goes with it
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read from there: a short plan that outlives lost executors."""
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
