"""What the operators share: the shared folder, cutting lineage through written tables, and byte-level words."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, set to a new temporary folder only where unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = tempfile.mkdtemp(prefix="dcbspark-shared-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that :func:`materialise` wrote and nobody has removed yet, in order.
_WRITTEN: list[str] = []


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again, so that later jobs neither repeat nor lose its work. The
    folder goes by :func:`drop_written`, :func:`drop_since` or, at the latest, as the driver ends. What planning and compiling
    took of the driver's memory outside its heap is given back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.unregister(_at_exit)
        atexit.register(_at_exit, spark)  # runs before the session's own end, which was registered earlier
    _WRITTEN.append(path)
    df.write.parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _at_exit(spark: SparkSession) -> None:
    if spark.sparkContext._jsc is not None:
        drop_since(spark, 0)


def written() -> int:
    """A mark for :func:`drop_since`."""
    return len(_WRITTEN)


def drop_since(spark: SparkSession, mark: int, keep: int = 0) -> None:
    """Remove the tables written since a mark but for the newest ``keep``: for when all plans that read them have run."""
    gone = _WRITTEN[mark : len(_WRITTEN) - keep]
    del _WRITTEN[mark : len(_WRITTEN) - keep]
    for folder in gone:
        _remove(spark, folder)


def drop_written(df: DataFrame) -> None:
    """Remove the files of a table that :func:`materialise` wrote and that no later plan reads."""
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _remove(df.sparkSession, folder)
        name = folder.rpartition("/")[2]
        _WRITTEN[:] = [w for w in _WRITTEN if w.rpartition("/")[2] != name]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1 and so on, so that no column clashes with an operator's own."""
    return df.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)))


def renamed(df: DataFrame, names: list[str], *more: Column) -> DataFrame:
    """Columns c0, c1 and so on under their ``names`` again, then others."""
    return df.select(*(F.col(f"c{k}").alias(n) for k, n in enumerate(names)), *more)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with underscores after it until none of the taken names is the same."""
    held = {t.lower() for t in taken}
    while name.lower() in held:
        name += "_"
    return name


#: Parts into which a hot key's rows are dealt.
SALTS = 8


def salted_join(left: DataFrame, right: DataFrame, on: str, spread: str, how: str = "inner") -> DataFrame:
    """A join on one column whose values may each hold very many rows of ``left``, which are dealt by ``spread`` to ``SALTS``
    parts; ``right`` has one row a value and is repeated for each part, so it should be the smaller side."""
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return left.withColumn("__salt", salt).join(right.withColumn("__salt", every), [on, "__salt"], how).drop("__salt")


def byte_words(text: str | None) -> list[bytes]:
    """Words of a text after lower-casing A to Z only: runs of anything but space and U+0009 to U+000D."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def slices(batch: pa.RecordBatch, column: str = "text", most_bytes: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in parts of bounded text, so that very long texts don't add up; a part has one row at least."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    at = 0
    while at < len(sizes):
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most_bytes, side="right")))
        yield batch.slice(at, n)
        at += n


def coded(lists: pa.ListArray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Lists of strings as (distinct strings, their codes in order, start of each list with the end of the last)."""
    offsets = np.asarray(lists.offsets).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    return words.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(words.indices), offsets - offsets[0]


def coded_words(text: pa.Array, lower: bool = True) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The words of each text (see :func:`byte_words`), coded; null counts as empty."""
    text = pc.fill_null(text.cast(pa.string()), "")
    words, codes, starts = coded(pc.ascii_split_whitespace(pc.ascii_lower(text) if lower else text))
    if "" in words:  # before leading or after trailing white space
        full = codes != words.index("")
        starts = np.concatenate([[0], np.cumsum(full)])[starts]
        codes = codes[full]
    return words, codes, starts


#: What this worker remembers from task to task, of one operator at a time: Spark hands a worker to many, one after another.
_MEMORY: dict[tuple, Any] = {}


def memory(*key: Any, make: Callable[[], Any]) -> Any:
    """What an operator remembers in this worker under a key (its name and a model or file). What another operator or key
    left behind is let go first."""
    if key not in _MEMORY:
        forget()
        _MEMORY[key] = make()
    return _MEMORY[key]


def forget() -> None:
    """Let all memories go."""
    if _MEMORY:
        _MEMORY.clear()
        gc.collect()
        give_back()


def give_back() -> None:
    """Freed memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Memory that the driver's JVM took outside its heap and freed goes back to the system; a no-op where the JVM can't. It is
    freed by many threads, each with an arena of the allocator's, which keeps it otherwise: in a driver that has run some
    hundred plans, hundreds of megabytes."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array

    def filled(kind, *values):
        out = array(kind, len(values))
        for k, value in enumerate(values):
            out[k] = value
        return out

    try:  # by reflection, for the server's own class isn't open to Py4J
        of = jvm.java.lang.Class.forName
        kinds = map(of, ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;"))
        invoke = of("javax.management.MBeanServer").getMethod("invoke", filled(jvm.java.lang.Class, *kinds))
        bean = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), filled(jvm.java.lang.Object, bean, "systemTrimNativeHeap", None, None))
    except Py4JError:  # no such command in older JVMs, nor without glibc
        pass


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], remember: bool = True):
    """A task's function that gives freed memory back at its end, and all it remembers unless the next task is to have it:
    Spark keeps more workers than run at a time, and an idle one holds on to what it has."""

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(rows)
        if not remember:
            forget()
        give_back()

    return task


#: Bytes, as estimated, that one memory may hold, and the longest string that is remembered.
MOST_BYTES = 64 << 20
LONGEST = 64


class Recent(dict):
    """What ``make`` gave for a string, in two generations of ``most`` bytes each: a full young one becomes the old one, and
    what is met again moves back, so that frequent strings stay. Long strings are made anew each time."""

    def __init__(self, make: Callable[[str], Any], each: int = 300, most: int = MOST_BYTES):
        super().__init__()
        self.make, self.each, self.most, self.held, self.old = make, each, most, 0, {}

    def __missing__(self, key: str) -> Any:
        known = self.old.get(key)
        if known is None:
            known = self.make(key)
        if len(key) <= LONGEST:
            self.held += self.each + 2 * len(key)
            if self.held > self.most:
                self.old, self.held = self.copy(), 0
                self.clear()
            self[key] = known
        return known


class Remembered:
    """Rows of a numpy table by string, learnt when first met; forgotten all at once beyond ``most`` bytes and one batch."""

    def __init__(self, learn, kind, most: int = MOST_BYTES):
        self.learn, self.kind, self.most = learn, np.dtype(kind), most
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.table = np.zeros(1 << 12, self.kind)
        self.held = 0

    def rows(self, words: list[str]) -> np.ndarray:
        if self.held > self.most:
            self.clear()
        at = self.at
        new = [w for w in words if w not in at]
        if new:
            n = len(at)
            while n + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[n : n + len(new)] = self.learn(new)
            at.update(zip(new, range(n, n + len(new)), strict=True))
            self.held += sum(map(len, new)) + len(new) * (200 + self.table[:1].nbytes)
        return self.table[np.fromiter(map(at.__getitem__, words), np.int64, len(words))]
