"""Session helpers shared by all operators: reading tables and cutting lineage."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def lazy_udf(kind: str):
    """A pandas UDF with a DDL return type that is made when first used, so that modules import without a session."""

    def of(f):
        @functools.wraps(f)
        def call(*columns):
            return F.pandas_udf(f, kind)(*columns)

        return call

    return of


def let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, where it would otherwise be repeated inside a lambda."""
    return F.get(F.transform(F.array(value), use), 0)


_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once for each Spark context.

    Nothing is shipped where ``PYTHONPATH``, which executors inherit, already holds the package.
    """
    sc = spark.sparkContext
    root = os.path.dirname(_PACKAGE)
    if getattr(sc, "_attestra_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "attestra"), "zip", root, "attestra")
    sc.addPyFile(archive)  # served by the driver; executors fetch their own copy
    sc._attestra_shipped = True


def _small_batches(spark: SparkSession) -> None:
    """Arrow batches of 2,000 rows where the session has the default of 10,000: texts are long, and a batch is held whole in a worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "2000")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One parquet table, pruned to ``columns`` when any are given."""
    ship(spark)
    _small_batches(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session.

    ``spark.checkpoint.dir`` names it on a cluster. A folder of our own is set
    only where neither that setting nor a checkpoint folder exists and all tasks run
    on this machine (tests); on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), "attestra-checkpoints")
    sc.setCheckpointDir(path)
    return path


#: Rows up to which a side of a join is broadcast.
BROADCAST_ROWS = 200_000


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has ``rows`` at most, which is checked first; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table into the shared checkpoint folder and read back.

    Lineage, and with it the plan, ends there; the files outlive any executor. A
    table is taken rather than ``checkpoint()`` because the latter keeps the
    constraints of the plan it cuts, which grow with every round of a loop.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._attestra_path = path  # for free()
    return made


def free(df: DataFrame) -> None:
    """Delete what :func:`cut` wrote for ``df``; nothing may read it any more."""
    path = getattr(df, "_attestra_path", None)
    if path:
        jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)
