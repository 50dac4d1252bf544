"""The session's side of things: modules for Python workers, the shared folder, tables written there."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Send the package's modules to the workers, once a context; not needed where PYTHONPATH names its folder."""
    sc = spark.sparkContext
    if ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_lorespark_sent", False):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lorespark-"), "lorespark.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(os.path.join(ROOT, "lorespark")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, ROOT))
    sc.addPyFile(path)
    sc._lorespark_sent = True


def java_udf(spark: SparkSession, name: str, returns: T.DataType) -> Callable[..., Column]:
    """The class lorespark/java/<name>.java as a function of columns. Janino, which Spark compiles its own plans with,
    compiles it on the driver, and executors get it as a jar, both once a context."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lorespark_java"):
        sc._lorespark_java = {}
    if name not in sc._lorespark_java:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        compiler.cook(pkgutil.get_data("lorespark", f"java/{name}.java").decode())
        path = os.path.join(tempfile.mkdtemp(prefix="lorespark-"), f"lorespark-{name}.jar")
        with zipfile.ZipFile(path, "w") as z:
            for full, code in dict(compiler.getBytecodes()).items():
                z.writestr(full.replace(".", "/") + ".class", bytes(code))
        sc._jsc.addJar(path)
        sc._lorespark_java[name] = compiler.getClassLoader().loadClass(f"lorespark.{name}").newInstance()
    kind = sc._jvm.org.apache.spark.sql.types.DataType.fromJson(returns.json())
    spark._jsparkSession.udf().register(f"lorespark_{name}", sc._lorespark_java[name], kind)
    return lambda *columns: F.call_udf(f"lorespark_{name}", *columns)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); only where it is unset and all runs on this machine (tests) a
    folder of our own."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not known:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = tempfile.mkdtemp(prefix="lorespark-")
        sc.setCheckpointDir(known)
    return known


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a written table in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors, and gives all that reads it
    the same rows."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._scratch)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
