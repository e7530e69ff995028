"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Words of the contracts: maximal runs of anything but ASCII white space.
#: ``bytes.split()`` splits UTF-8 at exactly these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Arrow bytes that a Python worker turns into objects at once.
SLICE_BYTES = 4 << 20


_MADE: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset and the master is local, a temporary folder is made once
    for the application; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _MADE:
        _MADE[application] = "file://" + tempfile.mkdtemp(prefix="wickline-")
    return _MADE[application]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wickline/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of this table, not the
    stages before it.  The files stay until ``remove`` or the folder's owner
    deletes them.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    lighten(df.sparkSession)
    _WRITTEN.append((name, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: (name, path) of the tables that this driver has written.
_WRITTEN: list[tuple[str, str]] = []


def tables(spark: SparkSession) -> Callable[..., None]:
    """A function that removes the tables written since now but those of the names given, once nothing reads them."""
    begun = len(_WRITTEN)

    def done(*keep: str) -> None:
        later = _WRITTEN[begun:]
        _WRITTEN[begun:] = [(name, path) for name, path in later if name in keep]
        for name, path in later:
            if name not in keep:
                remove(spark, path)

    return done


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any file system that Hadoop knows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return freed memory to the system: a reused worker would hold the largest task's until it ends."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


#: Seconds that pass at least between two calls of ``lighten`` that do something, and the last one's time.
LIGHTEN_S = 10.0
_LIGHTENED = [float("-inf")]


def lighten(spark: SparkSession) -> None:
    """Have the driver's JVM collect garbage, shrink its heap and return freed native memory to the system.

    Left alone its heap grows before it collects, and what plans, compilers and
    buffers freed outside the heap stays with the process.  Shuffles and
    broadcasts that nothing refers to any more are cleaned by the way.
    """
    if time.monotonic() < _LIGHTENED[0] + LIGHTEN_S:
        return
    gc.collect()
    spark._jvm.System.gc()
    try:
        _trim_native(spark)
    except Py4JError:  # another JVM or system than HotSpot on glibc: only the heap is collected
        pass
    _LIGHTENED[0] = time.monotonic()


def _trim_native(spark: SparkSession) -> None:
    """``jcmd System.trim_native_heap`` from within; called by the public interface, as the server's class isn't open."""
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    types = ["javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"]
    taken, given = new_array(jvm.java.lang.Class, 4), new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(types):
        taken[k] = jvm.java.lang.Class.forName(name)
    invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", taken)
    given[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    given[1] = "systemTrimNativeHeap"
    invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)


def slices(batches: Iterator[pa.RecordBatch], size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of about ``size`` bytes, so that a worker holds few Python objects at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * size // max(batch.nbytes, 1))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def with_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    factory: Callable[[], Callable[..., list]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add ``fields``, computed by Arrow batches from the columns ``inputs``.

    ``factory`` runs once a task and returns a function from Arrow arrays to
    one array or list a field.  ``keep``: the columns to carry along (default
    all).  A column of the input with the name of a new field is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    carried = [c for c in df.columns if c in set(kept) | set(inputs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        make = factory()
        for batch in slices(batches):
            made = make(*[batch.column(c) for c in inputs])
            columns = [batch.column(c) for c in kept]
            for field, values in zip(list(target)[len(kept) :], made):
                columns.append(values.cast(field.type) if isinstance(values, pa.Array) else pa.array(values, field.type))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(target, columns)]))
        del make
        give_back()

    return df.select(*[df[f"`{c}`"] for c in carried]).mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes, null as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def hidden(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` has no column of."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def local_path(path: str) -> str:
    return path[7:] if path.startswith("file://") else path[5:] if path.startswith("file:") else path


def exists_locally(path: str) -> bool:
    return os.path.exists(local_path(path))
