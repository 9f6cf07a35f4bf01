"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a side that is broadcast at most; a row of the tables it is used for has 64 bytes or less.
BROADCAST_ROWS = 500_000


#: Paths of the tables written by this process.
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset (tests, one machine) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="semweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/semweave-{name}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def drop_staged(table: DataFrame) -> None:
    """Delete a written table that nothing reads any more: what was made of it is written too."""
    for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
        if "/semweave-" in path:
            delete_path(table.sparkSession, path)


def clear_staged(spark: SparkSession) -> None:
    """Delete all tables that this process has written. Results that still read them can't be read afterwards."""
    while _staged:
        delete_path(spark, _staged.pop())


def broadcast_if_small(staged: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``staged``, a written table of short rows, marked for broadcast if it has few; else joins exchange it."""
    return F.broadcast(staged) if staged.count() <= rows else staged
