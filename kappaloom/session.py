"""Session helpers: shared scratch space, small written tables, literal tables."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
PARTITIONS_CONF = "spark.kappaloom.items.partitions"


def scratch_root(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it.

    Only a local master without a setting gets a folder of its own; a cluster
    without one is an error, because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="kappaloom-")
    spark.conf.set(CHECKPOINT_CONF, own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path nobody used before, under the shared scratch folder."""
    return f"{scratch_root(spark).rstrip('/')}/kappaloom/{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in shared scratch and read it back.

    This cuts the lineage, survives the loss of executors, runs a non-repeatable
    input once, and gives the planner real file sizes, so that it chooses a
    broadcast join by itself exactly where the table is small enough for one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame, *keys: str) -> DataFrame:
    """Deal a plain scan to the number of tasks that ``PARTITIONS_CONF`` asks for, if it is set.

    For a machine whose one small file would otherwise be one task. Nothing is dealt unless
    the session asks for it: a cluster's inputs have splits enough.
    """
    wanted = scan.sparkSession.conf.get(PARTITIONS_CONF, None)
    return scan.repartition(int(wanted), *keys) if wanted else scan


def literal_table(spark: SparkSession, schema: pa.Schema, rows: list[tuple]) -> DataFrame:
    """A driver-side table of a few rows whose size the planner knows exactly."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    arrays = [pa.array(list(c), type=f.type) for c, f in zip(columns, schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=schema))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the file or folder is there, in any store that Spark reads."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)
