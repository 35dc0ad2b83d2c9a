"""What the operators of this subpackage share: tables, scratch space, words."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid
from contextlib import contextmanager
from functools import lru_cache, wraps
from inspect import signature

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of characters that aren't ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
word_re = re.compile(WORD)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where a local session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.gettempdir() + "/checkpoints/lodeframe"
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path for a table that cuts lineage."""
    return f"{shared_dir(spark)}/lodeframe-{what}-{uuid.uuid4().hex}"


#: With this setting Spark deletes the shuffle files of a query when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Queries inside leave no shuffle files behind."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def settle(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there, so lost executors cost no recomputation, and the shuffles that made it go."""
    spark = df.sparkSession
    path = path or scratch(spark, what)
    with tidy(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A settled table has this many files, or as many as its rows or bytes ask for: a small one isn't scattered over as many as there are shuffle partitions.
FEW, ROWS_A_FILE, BYTES_A_FILE = 24, 20_000, 16 << 20


def files_for(rows: int = 0, volume: int = 0) -> int:
    return max(FEW, rows // ROWS_A_FILE, volume // BYTES_A_FILE)


class Tables:
    """Settled tables of one run by name. A name written again drops its table before, once the new one is whole."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.what = spark, what
        self.paths: dict[str, str] = {}

    def write(self, df: DataFrame, name: str, parts: int | None = None) -> DataFrame:
        """The table, in ``parts`` files at most."""
        path = scratch(self.spark, f"{self.what}-{name}")
        out = settle(df.coalesce(parts) if parts else df, name, path)
        self.drop(name)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            if name in self.paths:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def docs_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """Only the columns an operator needs, so that others can't clash; a null text reads as an empty one."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c) for c in more))


def text_volume(df: DataFrame, text_col: str = "text") -> tuple[int, int]:
    """Rows and bytes of text."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()
    return n, size or 0


@lru_cache(maxsize=1)
def _trim():
    """glibc's call that returns freed memory to the system, or one that does nothing."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0) if sys.platform == "linux" else lambda pad: 0


def give_back() -> None:
    """Return what this process has freed to the system. A Python worker lives on between tasks and operators, and its allocators would keep it, beside a JVM that needs it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    _trim()(0)


def drop_codecs() -> None:
    """Forget the tokenizers and tables of chunks that a worker remembers for tasks that encode."""
    if bpe := sys.modules.get(f"{__package__}.bpe"):
        bpe.forget()


def tidied(run, codecs: bool = False):
    """A function for mapInArrow whose worker keeps as little as can be once its task is done, and that holds no codecs of operators before it but where ``codecs`` says that it encodes."""

    @wraps(run)
    def whole(batches):
        if not codecs:
            drop_codecs()
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def tidied_groups(run):
    """The same for a function of applyInArrow, which is called for each group, with one table or two."""

    def whole(*tables):
        drop_codecs()
        try:
            return run(*tables)
        finally:
            give_back()

    if len(signature(run).parameters) == 1:  # Spark looks at how many there are
        return lambda table: whole(table)
    return lambda left, right: whole(left, right)


def pieces(batches, chars: int = 2_000_000):
    """Slices of Arrow batches whose text column ``text`` holds about so many bytes, and one row at least."""
    import numpy as np
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index("text"))), 0).to_numpy(zero_copy_only=False).astype("int64"))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + chars, "right")))
            yield batch.slice(start, stop - start)
            start = stop
