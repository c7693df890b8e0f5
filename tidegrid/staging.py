"""Written intermediate tables.

Tables that several later steps read (per-series constants, block summaries, the
bucket table) are written once as parquet below the shared checkpoint folder and
read back.  A lost executor then costs a re-read, not a recomputation, and the
file size gives the optimizer true statistics for its join choice.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_recorders: list[list[tuple[str, str]]] = []


def shared_dir(spark: SparkSession) -> str:
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if path:
        return path
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="tidegrid-")
    sc.setCheckpointDir(path)
    return path


def _own_dir(spark: SparkSession) -> str:
    """Folder of this application alone, so that jobs that share the folder don't meet."""
    return f"{shared_dir(spark)}/tidegrid/{spark.sparkContext.applicationId}"


def plan_text(df: DataFrame) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@contextmanager
def recorded_plans() -> Iterator[list[tuple[str, str]]]:
    """Name and plan of every table that is staged inside, for tests and tuning."""
    plans: list[tuple[str, str]] = []
    _recorders.append(plans)
    try:
        yield plans
    finally:
        _recorders.remove(plans)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    for plans in _recorders:
        plans.append((name, plan_text(df)))
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stages(spark: SparkSession) -> None:
    """Delete the tables that :func:`stage` wrote in this application; call it once results are saved."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
