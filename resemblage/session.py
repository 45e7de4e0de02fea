"""Sessions, and making the package known to executors."""

from __future__ import annotations

import os
import re
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

ROOT = Path(__file__).resolve().parent.parent


def local_session(app: str = "resemblage", cores: str | int = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session on this machine, for tests, the bench and the command line."""
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([str(ROOT), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, once for each Spark context.

    Where the workers inherit a PYTHONPATH that has it, nothing is sent. Else
    a zip of the package goes through Spark's own file server.
    """
    sc = spark.sparkContext
    if getattr(sc, "_resemblage_shipped", False):
        return
    if str(ROOT) not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        archive = os.path.join(sc._temp_dir, "resemblage.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for path in sorted((ROOT / "resemblage").rglob("*.py")):
                z.write(path, path.relative_to(ROOT))
        sc.addPyFile(archive)
    sc._resemblage_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where all run on this machine it may be unset, as in tests; then it is one below the warehouse. Elsewhere executors would
    each write to a disk of their own, so it is an error.
    """
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "local")):
        raise RuntimeError("on a cluster spark.checkpoint.dir has to name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read often, computed once, there when an executor is lost.

    It goes when the driver ends, not before: a result may be computed from it at any time till then.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, path: str, now: bool = False) -> None:
    """Deletes what is at ``path``, at once or when the driver ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(where, True) if now else fs.deleteOnExit(where)


def numbered(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with the place of each row in ``order``, from 0, in ``name``. Rows are sorted by ranges, and each range numbers its own."""
    rows = written(df.orderBy(*order).withColumn(name, F.monotonically_increasing_id()))
    part = F.shiftright(name, 33)
    before = Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(part.alias("p")).count().select("p", F.coalesce(F.sum("count").over(before), F.lit(0).cast("long")).alias("start"))  # a row for each range
    return rows.join(F.broadcast(starts), part == F.col("p")).withColumn(name, F.col("start") + F.col(name).bitwiseAND(F.lit((1 << 33) - 1))).select(*df.columns, name)
