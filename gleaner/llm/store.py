"""Tables in the folder that driver and executors share.

Lineage is cut by writing a Parquet table below ``spark.checkpoint.dir``, so a lost executor never
costs more than the tasks it ran: whatever comes after reads the table again.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a few short fields each that may be broadcast (some 30 MB).
BROADCAST_ROWS = 400_000


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; a temporary one only where none is set and Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="gleaner-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call gets."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.gleaner_path = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes a table made by :func:`written`, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.gleaner_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, marked for a broadcast if it has few rows; beyond, the same join shuffles."""
    return F.broadcast(table) if table.count() <= rows else table


def give_back(spark: SparkSession) -> bool:
    """Has the driver's JVM collect its garbage and return freed memory to the system; whether it could do the latter.

    Until it collects, broadcasts and shuffle files of queries that are over stay, and the heap grows to its limit. What
    compilers and threads have freed outside the heap stays with the C library until it is trimmed.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    kinds, arguments = new_array(jvm.Class, 4), new_array(jvm.Object, 4)
    for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[i] = jvm.Class.forName(kind)
    try:  # by the interface's method, as py4j does not see the server's own class
        arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        jvm.Class.forName("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JError:  # a JVM without this command, or without glibc
        return False
    return True
