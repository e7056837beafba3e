"""Folders and tables that the driver and every executor share."""

from __future__ import annotations

import contextlib
import pathlib
import tempfile
import time
import uuid
import zipfile
from collections.abc import Callable, Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .text import release

_own: dict[str, str] = {}
#: Paths of the tables that stand now; all are deleted when the driver ends.
_made: list[str] = []
#: Once a step's result stands in a table, its shuffle files are of no more use; else they stay until the driver happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Giving memory back takes the driver one second in so many at most.
GIVE_BACK_SHARE = 20
#: When the driver last gave memory back, and the seconds that it took.
_gave = {"at": 0.0, "took": 0.0}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local one only where none is set and one process does all (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="plainframe-")
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A place in the shared folder for a table of these operators, that goes when the driver ends."""
    return passing(spark, f"{shared_dir(spark)}/plainframe-{name}-{uuid.uuid4().hex}")


def passing(spark: SparkSession, path: str) -> str:
    """path, which goes when the driver ends, or before with the scratch around it."""
    where, files = _place(spark, path)
    files.deleteOnExit(where)
    _made.append(path)
    return path


class Files:
    """Small files of a folder in any store that Spark reaches."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _at(self, name: str):
        return _place(self.spark, f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        where, files = self._at("")
        return [x.getPath().getName() for x in files.listStatus(where)] if files.exists(where) else []

    def read(self, name: str) -> str:
        where, files = self._at(name)
        stream = files.open(where)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Written beside and renamed, so that nobody reads a part of it."""
        where, files = self._at(name)
        draft = self._at(f"draft-{uuid.uuid4().hex}")[0]
        stream = files.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        if not files.rename(draft, where):
            raise OSError(f"{where.toString()} is there already")

    def move(self, name: str, to: str) -> bool:
        """Whether there was something of that name."""
        where, files = self._at(name)
        return files.exists(where) and files.rename(where, self._at(to)[0])

    def delete(self, name: str) -> None:
        where, files = self._at(name)
        files.delete(where, True)


def trim(spark: SparkSession) -> str:
    """Give back what the driver's JVM has freed outside its heap (jcmd System.trim_native_heap); what it says, empty where it can't.

    Its compilers and codecs allocate on many threads, and the allocator keeps what they free.
    """
    jvm = spark._jvm

    def array(kind, *values):
        out = spark.sparkContext._gateway.new_array(kind, len(values))
        for i, x in enumerate(values):
            out[i] = x
        return out

    text, any_ = jvm.java.lang.String, jvm.java.lang.Object
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    command = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    arguments = array(any_, command, "systemTrimNativeHeap", array(any_, array(text)), array(text, "[Ljava.lang.String;"))
    try:
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), arguments)
    except Py4JJavaError:  # not on this system, or a JVM before 17.0.9
        return ""


def give_back(spark: SparkSession) -> bool:
    """Give back the memory that the driver's JVM and Python no longer use, unless that was done just now; whether it was done.

    Else plans, task records and broadcasts of steps long done stay until the heap is nearly full.
    """
    began = time.monotonic()
    if began - _gave["at"] < GIVE_BACK_SHARE * _gave["took"]:
        return False
    spark._jvm.System.gc()
    trim(spark)
    release()
    _gave.update(at=time.monotonic(), took=time.monotonic() - began)
    return True


def save(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write df as Parquet, in a folder for each value of by if given; its shuffle files go, and with them what the driver has freed."""
    spark = df.sparkSession
    before = spark.conf.get(CLEAN_UP)
    spark.conf.set(CLEAN_UP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    give_back(spark)


def write_table(df: DataFrame, name: str, even: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors.

    even: first rebalance rows of small results into few files of Spark's advisory size, rather than
    a small file for each task.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    save(df.hint("rebalance") if even else df, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._plainframe_path = path
    return out


def _place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)
    if path in _made:
        _made.remove(path)


def drop_table(df: DataFrame) -> None:
    """Delete a table that write_table made, once nothing lazy reads it any more."""
    path = getattr(df, "_plainframe_path", None)
    if path:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def scratch(spark: SparkSession, *kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Around operators and the action that writes their result: tables that they made inside are deleted at its end.

    Results are lazy and read their tables when an action runs, so only the caller knows when they have
    served. Without this, tables stay until the driver ends. What the list that this gives holds stays.
    """
    before, keep = set(_made), list(kept)
    try:
        yield keep
    finally:
        stay = before | {getattr(x, "_plainframe_path", None) for x in keep}
        for path in [x for x in _made if x not in stay]:
            _delete(spark, path)


#: A key is hot if it has more than one in so many of all rows; so there are fewer hot keys than that.
HOT_SHARE = 1000


def hot_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int, how: str = "inner") -> DataFrame:
    """left joined with right on key (how: inner or left), with no hot key's rows in one task.

    right has a row for each key, and in n how many rows of left have it; total is the sum of n or
    more. Hot keys are HOT_SHARE at most, so right's rows for them go to every task and left's stay where they
    are; the others meet by a shuffle. Both are best written tables, since each is read more than once.
    """
    counts = right.agg(F.min(n).alias("least"), F.max(n).alias("most")).first()
    if (counts.most or 0) * HOT_SHARE <= total:  # no key is hot
        return left.join(right, key, how)
    if counts.least * HOT_SHARE > total and how == "inner":  # all are, so right is small
        return left.join(F.broadcast(right), key)
    hot, rest = right.filter(F.col(n) * HOT_SHARE > total), right.filter(F.col(n) * HOT_SHARE <= total)
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti")
    return left.join(F.broadcast(hot), key).unionByName(cold.join(rest, key, how))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, value being computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


#: Rows that Spark reads and hands to Python at a time. Its defaults, 4096 and 10000, are for short rows: as many long texts make arrays of tens of MB.
ROWS_AT_A_TIME = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "16m"}


def ship(spark: SparkSession) -> SparkSession:
    """Ready a session for these operators: batches for long texts, and, once for each application, this package's code on the executors.

    The batch sizes stay set, since Spark reads them when a lazy result runs, after the operator returned.
    """
    context = spark.sparkContext
    for key, value in ROWS_AT_A_TIME.items():
        spark.conf.set(key, value)
    if context.applicationId in _shipped:
        return spark
    _shipped.add(context.applicationId)
    package = pathlib.Path(__file__).resolve().parent.parent
    out = pathlib.Path(tempfile.mkdtemp()) / "plainframe.zip"
    with zipfile.ZipFile(out, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    context.addPyFile(str(out))
    return spark
