"""Session helpers shared by all operators."""

from __future__ import annotations

import gc
import hashlib
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, base: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A machine-local folder is chosen only where the setting is absent, which is
    the case in tests on one machine.
    """
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if set_dir is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        set_dir = tempfile.mkdtemp(prefix="textloom-", dir=os.environ.get("TMPDIR"))
    sc.setCheckpointDir(set_dir)
    return set_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so that later plans neither repeat nor
    lose it when an executor goes away."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def slots(spark: SparkSession) -> int:
    """Partitions for CPU-bound Python stages: those of a shuffle, so that they grow with the data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """``df`` for a CPU-bound stage: as its files are split, or shuffled if that makes fewer partitions
    than there are cores."""
    sc = df.sparkSession.sparkContext
    return df if df._jdf.queryExecution().toRdd().getNumPartitions() >= sc.defaultParallelism else df.repartition(max(slots(df.sparkSession), sc.defaultParallelism))


def keep(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: like :func:`cut`, for rows of
    which later plans read different columns. The tables of a session are deleted when it ends."""
    spark = df.sparkSession
    folder = f"{checkpoint_dir(spark).rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(root)
    return spark.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that have run and are referred to no more, which it
    does when the driver collects garbage. Worth it after a stage that shuffled whole texts."""
    gc.collect()
    spark._jvm.System.gc()
    trim(spark)


def trim(spark: SparkSession) -> bool:
    """Gives the system back what the driver's JVM has freed outside its heap, which the C library else
    keeps for the threads that had it: plans, compiled code and messages of a job of many steps leave
    hundreds of MB. False where the JVM has no such command."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    java = jvm.java.lang
    try:
        kinds, values = array(java.Class, 4), array(java.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.Class.forName(kind)
        values[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        values[1] = "systemTrimNativeHeap"
        values[2], values[3] = array(java.Object, 0), array(java.String, 0)
        # by the interface: the server's own class may not be called from outside
        invoke = java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        invoke.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        return False
    return True


#: Share of the heap it may have that the driver holds before :func:`relieve` collects its garbage.
FULL = 0.5


def relieve(spark: SparkSession) -> None:
    """For between the steps of a job of many: once the driver's heap has grown to FULL of what it may,
    collects plans, task events and sent tables of the steps that have run, after which it shrinks again.
    What lies freed outside the heap is given back in any case."""
    jvm = spark._jvm.java.lang.Runtime.getRuntime()
    if jvm.totalMemory() > FULL * jvm.maxMemory():
        tidy(spark)
    else:
        trim(spark)


def files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Path, size and modification time of the files under ``path``, from the file system's listing."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    if fs.getFileStatus(root).isFile():
        s = fs.getFileStatus(root)
        return [(s.getPath().toString(), s.getLen(), s.getModificationTime())]
    out, it = [], fs.listFiles(root, True)
    while it.hasNext():
        s = it.next()
        out.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(out)


def version(spark: SparkSession, path: str) -> str:
    """A name for what is stored under ``path`` now: another one after any of its files has changed."""
    return hashlib.sha1(repr(files(spark, path)).encode()).hexdigest()[:20]


def publish(spark: SparkSession, made: str, path: str) -> None:
    """Moves a folder that is complete to its place; if another run was first, its folder stays."""
    jvm = spark._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(made), jvm.org.apache.hadoop.fs.Path(path)
    fs = b.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(b) or not fs.rename(a, b):
        fs.delete(a, True)
