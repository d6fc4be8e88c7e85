"""Session, tables and materialisation shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def session(app: str = "tipstaff", cores: str = "*") -> SparkSession:
    """A local session with the settings the engine is tuned for; on a cluster the caller's own session is used."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers once a context, so they need neither an installation nor a search path."""
    sc = spark.sparkContext
    if getattr(sc, "_tipstaff_shipped", False):
        return
    here = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tipstaff-code-")) / "tipstaff_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(here.rglob("*.py")):
            out.write(f, f"{here.name}/{f.relative_to(here)}")
    sc.addPyFile(str(target))  # from the driver's disk; Spark serves it to the executors
    sc._tipstaff_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it in spark.checkpoint.dir.

    Only where the setting is absent and all runs on one machine (tests, a laptop) a local folder is made
    and set on the context; on a cluster without the setting this is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tipstaff-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df once to the shared folder and returns a scan of it.

    Cuts lineage: an executor lost later costs only a re-read. Written as Parquet, so column pruning,
    filters and size estimates work on what is read back.
    """
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_dir(spark)}/tipstaff/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if getattr(spark.sparkContext, "_tipstaff_scratch", None) is not None:
        spark.sparkContext._tipstaff_scratch.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that materialize writes inside are removed at the end; for work whose result is written or collected there."""
    sc = spark.sparkContext
    outer, sc._tipstaff_scratch = getattr(sc, "_tipstaff_scratch", None), []
    try:
        yield
    finally:
        written, sc._tipstaff_scratch = sc._tipstaff_scratch, outer
        for path in written:
            _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ordinal(df: DataFrame, by: str, name: str, weight: str | None = None) -> DataFrame:
    """df with name: the rows (or the sum of weight) before each row in the order of by, from 0.

    Rows are cut into ranges of by and written once; each range is numbered by itself, and only one sum a range
    reaches the driver. Equal values of by are numbered in any order.
    """
    ranged = materialize(df.repartitionByRange(by).withColumn("_range", F.spark_partition_id()), "ordinal")
    one = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    before, offsets = 0, []
    for r in sorted(ranged.groupBy("_range").agg(F.sum(one).alias("n")).collect()):
        offsets.append((r["_range"], before))
        before += r["n"]
    starts = df.sparkSession.createDataFrame(offsets, "_range int, _start bigint")  # one row a range
    run = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.withColumn("_in", F.coalesce(F.sum(one).over(run), F.lit(0))).join(F.broadcast(starts), "_range").withColumn(name, F.col("_start") + F.col("_in")).drop("_range", "_start", "_in")


def release(spark: SparkSession) -> None:
    """Removes every table written by materialize; for the end of a session, when no result is read any more."""
    _remove(spark, f"{shared_dir(spark)}/tipstaff")
