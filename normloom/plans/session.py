"""Session builder, table loading and scratch space shared by all executors."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "normloom", cpus: int | None = None, driver_memory: str = "8g") -> SparkSession:
    """A local session with the settings the plans assume; on a cluster, pass the same settings to spark-submit."""
    n = cpus or os.cpu_count() or 4
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", driver_memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once per application, so that their Python workers can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_normloom_shipped", False):
        return
    package, packed = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/normloom-{uuid.uuid4().hex[:12]}/normloom.zip")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(target)
    out.write(bytearray(packed.getvalue()))
    out.close()
    fs.deleteOnExit(target.getParent())
    sc.addPyFile(target.toString())
    sc._normloom_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: What one core should get at least before a shuffle of the input pays, in bytes of the optimizer's estimate.
SPLIT_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for steps that cost far more than a shuffle of their input.
    No job runs for it while a plan is built: a plan without exchanges and subqueries says how many splits its files have; any other is judged by the
    optimizer's estimate of its size. Large tables come in enough splits and pass unchanged; a small file of one split doesn't leave
    the other cores idle."""
    cores, done = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution()
    if not any(word in done.executedPlan().toString() for word in ("Exchange", "Subquery", "subquery")):
        return df.repartition(cores) if done.toRdd().getNumPartitions() < cores else df
    return df.repartition(cores) if int(done.optimizedPlan().stats().sizeInBytes()) < cores * SPLIT_BYTES else df


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset (tests on one machine), a temporary one."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    kept = getattr(sc, "_normloom_dir", None)
    if kept is None:
        kept = "file://" + tempfile.mkdtemp(prefix="normloom-")
        sc._normloom_dir = kept
        sc.setCheckpointDir(kept)
    return kept


class Scratch:
    """Written intermediate tables of one operator call, below the shared folder.

    Writing instead of caching cuts the lineage and survives lost executors. Tables dropped early free their
    disk at once; the rest goes when the application ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/normloom-{label}-{uuid.uuid4().hex[:12]}"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = self._path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path)
        self._fs.deleteOnExit(self._path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and return the DataFrame that reads it."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def write_counted(self, df: DataFrame, name: str) -> tuple[DataFrame, int]:
        """write() and the number of rows, counted while writing."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
        return out, seen.get["n"]

    def drop(self, name: str) -> None:
        self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name)), True)
