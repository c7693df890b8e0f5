"""A written stage that later jobs read without moving its rows.

The rows lie in a bucketed parquet table, by series and block of steps, sorted by step inside a file.  So
reductions to buckets and other groups inside a block need no exchange, in any number of later jobs and
variants.  A manifest beside the table says what produced it; a stage made by anything else is built anew.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.config import GridConfig
from tidegrid.functions.scalar import floor_div

BLOCK = "block"


def _table_name(path: str) -> str:
    return f"tidegrid_stage_{hashlib.sha256(path.encode()).hexdigest()[:20]}"


def _quoted(path: str) -> str:
    return "'" + path.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _manifest(spark: SparkSession, path: str) -> dict | None:
    """What the manifest says; null where there is none, as after a write that was broken off."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.schema("value string").text(f"{path}/manifest").first().value)


def _declared(spark: SparkSession, path: str, about: dict) -> DataFrame:
    """The table at ``path``, declared in the session's catalogue with its buckets."""
    fields = T.StructType.fromJson(about["schema"]).fields
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"create table if not exists {_table_name(path)} ({columns}) using parquet "
        f"clustered by (series_id, {BLOCK}) sorted by (series_id, step) into {int(about['buckets'])} buckets "
        f"location {_quoted(path + '/rows')}"
    )
    return spark.table(_table_name(path))


def reuse_or_build(
    spark: SparkSession,
    path: str,
    recipe: Mapping[str, object],
    build: Callable[[], DataFrame],
    grid: GridConfig,
    buckets: int = 64,
) -> DataFrame:
    """The stage at ``path``, written by ``build()`` unless it is there and its manifest names this ``recipe``.

    ``build`` gives rows with ``series_id`` and ``step``; a column ``block`` is added, whose borders
    are also borders of the grid's buckets.  ``recipe`` holds what the result depends on (inputs,
    parameters) as JSON values.  The manifest is removed before rows are written and
    written after them, so a stage that was broken off is not taken for a whole one.  Jobs that
    write the same ``path`` at the same time are not kept apart.  ``buckets`` is the number of files
    and of reading tasks; choose it so that a file fits a task.
    """
    wanted = json.loads(json.dumps({**recipe, "grid": repr(grid)}))
    about = _manifest(spark, path)
    if about is not None and about["recipe"] == wanted and about["buckets"] == buckets:
        return _declared(spark, path, about)
    rows = grid.block_rows - grid.block_rows % grid.downsample or grid.downsample
    df = build().withColumn(BLOCK, floor_div("step", rows))
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    spark.sql(f"drop table if exists {_table_name(path)}")  # the files of an external table stay
    # rows of one bucket in one task, so that a bucket is one file, which keeps its order
    placed = df.repartition(buckets, "series_id", BLOCK)
    writer = placed.write.mode("overwrite").format("parquet").option("path", f"{path}/rows")
    writer.bucketBy(buckets, "series_id", BLOCK).sortBy("series_id", "step").saveAsTable(_table_name(path))
    about = {"recipe": wanted, "buckets": buckets, "schema": df.schema.jsonValue()}
    manifest = spark.range(1, numPartitions=1).select(F.lit(json.dumps(about)).alias("value"))
    manifest.write.mode("overwrite").text(f"{path}/manifest")
    return _declared(spark, path, about)
