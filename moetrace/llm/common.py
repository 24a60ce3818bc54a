"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows an Arrow batch carries to Python: texts are long, so few rows keep a batch small.
ARROW_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in tests, where it is unset, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    where = spark.sparkContext.getCheckpointDir()
    if not where and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
    if not where:
        where = tempfile.mkdtemp(prefix="moetrace-")
        spark.sparkContext.setCheckpointDir(where)
    return where


def settle(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: later steps start from the files, not from the
    lineage, so a lost executor costs a reread. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/moetrace-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    collect_driver(spark)  # the driver drops the shuffles behind what was written once it collects their plans
    return spark.read.schema(df.schema).parquet(path)


#: Of the heap that a collection leaves to the driver, the percentage that may be free; by itself the JVM keeps 70.
MOST_FREE = 40


def collect_driver(spark: SparkSession) -> None:
    """A full collection in the driver, which then drops the shuffles behind what was written. What that frees goes back to
    the system: the heap beyond MOST_FREE, and what native code has freed (plans are compiled, files go through its
    buffers), which the C library else keeps in the arenas of threads. JVMs without these commands only collect."""
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    beans = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    # Through the public interface: the class of beans is closed to reflection.
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")

    def call(bean: str, method: str, *given: str) -> object:
        values, kinds, all_ = new_array(jvm.Object, len(given)), new_array(jvm.String, len(given)), new_array(jvm.Object, 4)
        for i, x in enumerate(given):
            values[i], kinds[i] = x, "java.lang.String"
        all_[0], all_[1], all_[2], all_[3] = jvm.javax.management.ObjectName(f"com.sun.management:type={bean}"), method, values, kinds
        return invoke.invoke(beans, all_)

    free = "70"
    with contextlib.suppress(Py4JError):
        free = call("HotSpotDiagnostic", "getVMOption", "MaxHeapFreeRatio").get("value")
        call("HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", str(min(MOST_FREE, int(free))))
    jvm.System.gc()
    with contextlib.suppress(Py4JError):
        call("HotSpotDiagnostic", "setVMOption", "MaxHeapFreeRatio", free)
    with contextlib.suppress(Py4JError):
        call("DiagnosticCommand", "systemTrimNativeHeap")


def among(df: DataFrame, ids: DataFrame, on: str) -> DataFrame:
    """Rows of df whose `on`, a long, is in that column of ids, a settled table. Where ids are few enough, Spark builds a
    Bloom filter of them (at most 8 MB; larger ids get none), so that other rows never reach the join's shuffle."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold", "0")
    conf.set("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold", "64m")
    # Spark builds the filter only from a side that has a condition: this one is always true.
    return df.join(ids.select(on).where(f"{on} >= -9223372036854775808"), on, "left_semi")


def release(*tables: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    jvm = tables[0].sparkSession.sparkContext._jvm
    conf = tables[0].sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for df in tables for f in df.inputFiles()}:
        if "/moetrace-" in folder:
            where = jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(conf).delete(where, True)


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Batches of at most so many rows from now on. Results are lazy, so the setting stays, and it only ever falls: a later
    operator never gives an earlier one's plan larger batches."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, which an operator is about to add."""
    return df.drop(*[c for c in df.columns if c in names])


class Shared:
    """A broadcast of an object of this package, pickled with its classes so that executors need no copy of them."""

    def __init__(self, spark: SparkSession, value: object):
        self._held, self._value = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"_held": self._held, "_value": None}

    def unpersist(self) -> None:
        self._held.unpersist()

    @property
    def value(self) -> object:
        if self._value is None:
            self._value = cloudpickle.loads(self._held.value)
        return self._value


def blocks(spark: SparkSession, least: int = 8) -> int:
    """How many blocks a group is cut into where its rows are numbered: as many as there are shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str, n_blocks: int) -> DataFrame:
    """Number the rows of each group from 0 without gaps, in an order that a hash of `order` sets.

    A group of any size is cut into n_blocks blocks by that hash: the blocks are counted (n_blocks rows a group), the
    counts before a block are summed, and rows are ranked only inside their block, so that no task sees a whole group.
    Rows that agree in all of `order` are interchangeable."""
    at = df.withColumn("_h", F.xxhash64(F.lit(name), *order)).withColumn("_block", F.pmod("_h", F.lit(n_blocks)))
    counts = at.groupBy(*group, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*group, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*group, "_block").orderBy("_h", *order)
    ranked = at.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(counts, [*group, "_block"]).withColumn(name, F.col("_before") + F.col("_rank")).drop("_h", "_block", "_before", "_rank")
