"""Shared pieces of the training-data operators: word rule, shared scratch tables, checks."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the six ASCII white-space characters (fixed value of the contracts).
WORD = r"[^\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)
#: Characters that str.split() takes as white space and WORD does not.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

_own_dirs: dict[str, str] = {}


def words_of(text: str | None) -> list[str]:
    """The words of a text in order; none for null. str.split() where it means the same."""
    if not text:
        return []
    return WORD_RE.findall(text) if _ODD_SPACE.search(text) else text.split()


def n_words(text: Column) -> Column:
    """Number of words as a JVM expression; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one of our own where that is unset and all run here (tests)."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + (folder := tempfile.mkdtemp(prefix="siftwell-"))
        atexit.register(shutil.rmtree, folder, True)
    return _own_dirs[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwell/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames that materialize() made and nothing that is still to run reads."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of an Arrow batch: texts may be long, and a batch is held whole in the JVM and in Python.
BATCH_ROWS = 500
BATCH_BYTES = 32 << 20


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of finished steps now: it does so when the driver drops what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def require(df: DataFrame, *names: str) -> None:
    missing = [x for x in names if x not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}; the table has {df.columns}")


def map_rows(df: DataFrame, schema: str, per_row, *columns: str) -> DataFrame:
    """df's ``columns`` through ``per_row(*values) -> tuple`` of ``schema``, in Arrow batches."""
    return df.select(*columns).mapInArrow(_Mapper(schema, per_row), schema)


def gathered(batches, least: int):
    """Batches put together to about ``least`` bytes: a word that stands in several is looked up once."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@lru_cache(maxsize=1)
def _c_library():
    """malloc_trim of the C library, where it has one; large blocks are mapped apart from now on, so that they can go."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 18)  # M_MMAP_THRESHOLD: else it grows to 32 MB with the blocks that are freed
        return c.malloc_trim
    except (OSError, AttributeError):
        return lambda pad: None


def trim() -> None:
    """Give the system back what this worker has freed: the C library and Arrow keep it else, for as long as the worker lives."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _c_library()(0)


_held: dict[str, Callable[[], None]] = {}


def hold(owner: str, clear: Callable[[], None] | None = None) -> None:
    """Called where a stage's Python code begins; ``clear`` empties what ``owner`` caches in the worker.

    A worker serves the stages of all operators one after the other: what others cached in it goes now.
    """
    others = [x for x in _held if x != owner]
    for other in others:
        _held.pop(other)()
    if others:
        gc.collect()
    trim()
    if clear:
        _held[owner] = clear


class _Mapper:
    def __init__(self, schema: str, per_row):
        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import StructType

        self.schema, self.per_row = to_arrow_schema(StructType.fromDDL(schema)), per_row

    def __call__(self, batches):
        import pyarrow as pa

        hold("rows")
        for b in batches:
            rows = [self.per_row(*x) for x in zip(*(c.to_pylist() for c in b.columns))]
            cols = list(zip(*rows)) if rows else [[] for _ in self.schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, self.schema)], schema=self.schema)
