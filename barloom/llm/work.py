"""Shared folder for intermediate tables, and the few session settings that the operators rely on."""

from __future__ import annotations

import atexit
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and runs on one machine, as in tests.
DEFAULT_DIR = "/tmp/checkpoints"
#: Rows in an Arrow batch, and bytes; documents can be long, so batches are kept short.
ARROW_ROWS, ARROW_BYTES = 500, 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; on a cluster it has to."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or DEFAULT_DIR


def session_of(df: DataFrame) -> SparkSession:
    """The session, whose Arrow batches are bounded in rows and bytes from now on (settings of the whole session)."""
    spark = df.sparkSession
    for key, value in (("maxRecordsPerBatch", str(ARROW_ROWS)), ("maxBytesPerBatch", f"{ARROW_BYTES}b")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") != value:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)
    return spark


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def trim() -> None:
    """Give the system back what this process has freed; Arrow and the C library keep it otherwise, also in an idle worker."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if release := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        release(0)


def trim_driver(spark: SparkSession) -> bool:
    """trim() for the driver's JVM, whose compilers free hundreds of MB that the C library keeps; whether this JVM can do it."""
    jvm, new = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    named, lang = jvm.java.lang.Class.forName, jvm.java.lang

    def array(of, *values):
        out = new(of, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    kinds = array(lang.Class, *map(named, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")))
    call = named("javax.management.MBeanServer").getMethod("invoke", kinds)  # by the interface: the server's own class is closed to Py4J
    bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    try:
        call.invoke(lang.management.ManagementFactory.getPlatformMBeanServer(), array(lang.Object, bean, "systemTrimNativeHeap", array(lang.Object), array(lang.String)))
    except Py4JJavaError:  # it has no such command
        return False
    return True


class Workspace:
    """Tables written under the shared folder, so that a lost executor costs no more than the stage it was in.

    They stay until drop() or the end of the driver, since the returned DataFrames read them lazily. After each of them the
    driver gives back what it has freed.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/barloom-{name}-{uuid.uuid4().hex[:12]}", 0
        self.paths: dict[int, str] = {}
        atexit.register(self.clear)

    def stash(self, df: DataFrame) -> DataFrame:
        """Write df as Parquet and return it as read back: its lineage is cut there."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        trim_driver(self.spark)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            if path := self.paths.pop(id(df), None):
                _delete(self.spark, path)

    def clear(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                _delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the driver is going away
            pass


def column(name: str, of: str = "") -> Column:
    """The column of that very name, whatever characters it has; of: of that struct."""
    return F.col(f"{of}{'.' if of else ''}`{name.replace('`', '``')}`")


def map_batches(df: DataFrame, make, schema: str) -> DataFrame:
    """Arrow batches of df through make()(*columns as lists), which returns the columns of schema, each a list or an array.

    make() runs once in each task, so what it builds (a cache, a tokenizer) serves all batches of the task; then it goes, and
    its memory with it, but for what worker_cache() holds.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    shape = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        import pyarrow as pa

        def results():
            for batch in batches:
                columns = f(*[c.to_pylist() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(columns, shape)], schema=shape)

        f = make()
        forget_others()
        yield from results()
        f = None
        trim()

    return df.mapInArrow(run, schema)


def worker_cache(name: str, make):
    """What make() built first in this Python process: later tasks of the same worker go on with it, until one doesn't ask for it."""
    held, asked = _held()
    asked.add(name)
    if name not in held:
        held[name] = make()
    return held[name]


def forget_others() -> None:
    """Drop what worker_cache() holds but this task hasn't asked for: a worker outlives its stage and goes on with other ones."""
    held, asked = _held()
    for name in held.keys() - asked:
        del held[name]
    asked.clear()


def _held() -> tuple[dict, set]:
    import sys
    import types

    module = sys.modules.setdefault("_barloom_worker", types.ModuleType("_barloom_worker"))
    return module.__dict__.setdefault("held", {}), module.__dict__.setdefault("asked", set())
