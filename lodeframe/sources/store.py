"""Tables of an index in one folder per project and scope."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import merge_by_key, replace_by_path

TABLES = ("chunks", "symbols", "observations", "canonical_facts", "derived_facts", "graph_nodes", "graph_edges", "overlay_edges", "overlay_nodes", "manifest")


def table_name(project: str, scope: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "_", f"{project}/{scope}").strip().lower()


def flatten_locations(rows: DataFrame) -> DataFrame:
    """start_line, end_line, doc_offset and section without nulls, and has_code_location."""
    return rows.withColumns({"has_code_location": F.col("start_line").isNotNull(), **{c: F.coalesce(c, F.lit(0)) for c in ("start_line", "end_line", "doc_offset")}, "section": F.coalesce("section", F.lit(""))})


def restore_locations(rows: DataFrame) -> DataFrame:
    """Back from flat columns. An offset of zero and an empty section read as absent."""
    code = F.col("has_code_location")
    lines = {c: F.when(code, F.col(c)) for c in ("start_line", "end_line")}
    return rows.withColumns({**lines, "doc_offset": F.nullif("doc_offset", F.lit(0)), "section": F.nullif("section", F.lit(""))}).drop("has_code_location")


class Store:
    """Parquet tables; a write makes a new version of a table beside the old one and then moves the pointer, so readers never see half of it."""

    def __init__(self, spark: SparkSession, root: str, project: str, scope: str = "shared"):
        self.spark, self.base = spark, f"{root.rstrip('/')}/{table_name(project, scope)}"
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.base).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, table: str) -> str | None:
        """The folder of the newest whole version."""
        base = self._path(f"{self.base}/{table}")
        if not self._fs.exists(base):
            return None
        done = [s.getPath().getName() for s in self._fs.listStatus(base) if self._fs.exists(self._path(f"{s.getPath()}/_SUCCESS"))]
        return f"{self.base}/{table}/{max(done)}" if done else None

    def read(self, table: str, **equal) -> DataFrame | None:
        """The table, filtered by equality; null if it was never written."""
        at = self._current(table)
        if at is None:
            return None
        df = self.spark.read.parquet(at)
        for column, value in equal.items():
            if value is not None:
                df = df.filter(F.col(column) == value)
        return df

    def replace(self, table: str, rows: DataFrame) -> None:
        old = self._current(table)
        number = int(old.rsplit("/v", 1)[1].split("-")[0]) + 1 if old else 0
        rows.write.parquet(f"{self.base}/{table}/v{number:08d}-{uuid.uuid4().hex[:8]}")
        for s in self._fs.listStatus(self._path(f"{self.base}/{table}")):
            name = s.getPath().getName()
            if name < f"v{max(0, number - 1):08d}":  # the version before stays for readers that still have it open
                self._fs.delete(s.getPath(), True)

    def upsert_by_path(self, table: str, rows: DataFrame, touched: DataFrame | None = None) -> None:
        """Rows of every path that the new rows touch are replaced; ``touched`` names further paths whose rows go."""
        old = self.read(table)
        if old is None:
            self.replace(table, rows)
            return
        if touched is not None:
            old = old.join(touched.select("path").distinct(), "path", "left_anti")
        self.replace(table, replace_by_path(old, rows))

    def records(self, table: str, key: str) -> DataFrame | None:
        """All rows in order of their key."""
        df = self.read(table)
        return None if df is None else df.orderBy(key)

    def merge(self, table: str, rows: DataFrame, key: str) -> None:
        """Rows with a known key replace it, others are added. A table of other columns or types is dropped and made anew from the rows alone."""
        old = self.read(table)
        shape = lambda df: {f.name: f.dataType.simpleString() for f in df.schema}
        drifted = old is None or shape(old) != shape(rows)
        self.replace(table, rows if drifted else merge_by_key(old, rows, key))

    def delete_by_path(self, table: str, path: str) -> None:
        old = self.read(table)
        if old is not None:
            self.replace(table, old.filter(F.col("path") != path))

    def drop(self, folder: str) -> None:
        self._fs.delete(self._path(folder), True)

    def clear(self, table: str | None = None) -> None:
        for t in [table] if table else TABLES:
            self._fs.delete(self._path(f"{self.base}/{t}"), True)
