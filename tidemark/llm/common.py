"""Storage and column helpers shared by the training-data operators.

Every intermediate table goes to the folder that the cluster names in
``spark.checkpoint.dir``: all executors reach it, so a lost executor costs a
re-read and never a recomputation of the whole plan.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import time
import uuid
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the word contracts define it: space and tab .. carriage return.
WORD_GAP = "[\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder.

    One of our own only where the session names none and runs in one process;
    on a cluster a folder of one machine would be out of the others' reach.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if found:
        return found
    if not re.match(r"local(\[|$)", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    found = tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(found)
    return found


#: Seconds between two settlings of the driver.
SETTLE_EVERY = 2.0
_settled = -SETTLE_EVERY


def settle(spark: SparkSession) -> bool:
    """Give what the driver's JVM has freed outside its heap back to the system, at most once in ``SETTLE_EVERY`` seconds; whether it was done.

    Plans are compiled on many threads, each with an allocator arena that keeps
    what it once held: hundreds of megabytes over a chain of operators.  A JVM
    that has no such command (before 17.0.9, or not on Linux) goes on as it is.
    """
    global _settled
    if time.monotonic() < _settled + SETTLE_EVERY:
        return False
    _settled = time.monotonic()
    jvm, new = spark._jvm, spark.sparkContext._gateway.new_array
    of = jvm.java.lang.Class.forName

    def array(kind, *values):
        out = new(kind, len(values))
        for i, v in enumerate(values):
            out[i] = v
        return out

    try:
        # by reflection, as the server's own class is not open to callers
        call = of("javax.management.MBeanServer").getMethod("invoke", array(jvm.java.lang.Class, *map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))))
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        none = array(jvm.java.lang.Object), array(jvm.java.lang.String)
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), array(jvm.java.lang.Object, name, "systemTrimNativeHeap", *none))
    except Py4JError:
        return False
    return True


#: Folders of runs that may still be read, oldest first.
_open: list[Scratch] = []


class Scratch:
    """Tables of one operator run under the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
        _open.append(self)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it again: lineage ends here."""
        df.write.mode("overwrite").parquet(self.path(name))
        settle(self.spark)
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self._delete(self.path(name))

    def close(self) -> None:
        """Delete the whole run."""
        self._delete(self.root)
        if self in _open:
            _open.remove(self)


@contextmanager
def scope():
    """Runs begun inside end with it: their results must be written by then."""
    before = list(_open)
    yield
    for run in [x for x in _open if x not in before]:
        run.close()


def fresh(taken: list[str], *names: str) -> list[str]:
    """``names``, each with as many underscores as it needs to differ from all ``taken`` ones."""
    used, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


#: Memos that a worker process keeps from task to task.
memos: list[dict] = []


def release() -> None:
    """Forget the memos of this process."""
    for memo in memos:
        memo.clear()


def tidy(run):
    """``run``, a function over batches, and then: what its task has freed goes from the worker process back to the system.

    Worker processes outlive their tasks, and allocators keep what was freed.
    They serve one operator after another, so memos of an earlier one go first.
    """

    def whole(batches):
        release()
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sum_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Null-safe equality of equally named columns."""
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def partitions_for(df_rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, -(-df_rows // per_partition))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
