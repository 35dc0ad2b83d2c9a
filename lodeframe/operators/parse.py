"""Columns and rows read out of documents: imports, package files, workflow steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import basename, extension, found

#: Patterns of the record formats.
IMPORT = r"""(?:import|export)\s+(?:[^"']+?\s+from\s+)?["']([^"']+)["']"""
NPM_RUN = r"npm\s+run\s+([\w:-]+)"
GATE_NAME = "lint|test|typecheck|check"
IMPORTING = r"\.(?:[cm]?[jt]sx?|mts|cts)$"


def language(path: Column) -> Column:
    ext = F.substring(extension(path), 2, 100)
    return F.when(ext != "", ext)


def imports(docs: DataFrame) -> DataFrame:
    """path, place, specifier, is_package of each import in script files."""
    rows = docs.filter(F.col("path").rlike(IMPORTING)).select("path", F.posexplode(F.regexp_extract_all("content", F.lit(IMPORT), 1)).alias("place", "specifier"))
    return rows.withColumn("is_package", ~F.col("specifier").startswith("."))


def package_name(path: Column, content: Column) -> Column:
    return F.when(basename(path) == "package.json", F.get_json_object(content, "$.name"))


def package_map(content: Column, key: str) -> Column:
    return F.map_entries(F.coalesce(F.from_json(F.get_json_object(content, f"$.{key}"), "map<string,string>"), F.create_map().cast("map<string,string>")))


def package_dependencies(docs: DataFrame) -> DataFrame:
    """path, place, package_name, name, version, in the order of the three dependency maps."""
    files = docs.filter(basename(F.col("path")) == "package.json")
    every = F.concat(*[package_map(F.col("content"), k) for k in ("dependencies", "devDependencies", "peerDependencies")])
    return files.select("path", package_name(F.col("path"), F.col("content")).alias("package_name"), F.posexplode(every).alias("place", "e")).select("path", "place", "package_name", F.col("e.key").alias("name"), F.col("e.value").alias("version"))


def package_scripts(docs: DataFrame) -> DataFrame:
    """path, place, package_name, name, command."""
    files = docs.filter(basename(F.col("path")) == "package.json")
    return files.select("path", package_name(F.col("path"), F.col("content")).alias("package_name"), F.posexplode(package_map(F.col("content"), "scripts")).alias("place", "e")).select("path", "place", "package_name", F.col("e.key").alias("name"), F.col("e.value").alias("command"))


def workflow_steps(lines: DataFrame) -> DataFrame:
    """path, place, command, name, script_name of each run line; lines: path, place, line. A name holds until the next run line."""
    seen = lines.withColumn("_name", found(F.col("line"), r"^\s*-\s*name:\s*(.+)$")).withColumn("_run", found(F.col("line"), r"^\s*run:\s*(.+)$"))
    before = Window.partitionBy("path").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    grouped = seen.withColumn("_group", F.coalesce(F.count("_run").over(before), F.lit(0)))
    upto = Window.partitionBy("path", "_group").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    steps = grouped.withColumn("_last", F.last("_name", ignorenulls=True).over(upto)).filter("_run IS NOT NULL")
    return steps.select("path", "place", F.col("_run").alias("command"), F.coalesce("_last", "_run").alias("name"), found(F.col("_run"), NPM_RUN).alias("script_name"))


def document_lines(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode(F.split("content", "\r?\n")).alias("place", "line"))


def quality_gates(scripts: DataFrame, steps: DataFrame) -> DataFrame:
    """path, tool, name, command, script_name."""
    a = scripts.filter(F.col("name").rlike(GATE_NAME)).select("path", F.lit("package-script").alias("tool"), "name", "command", F.col("name").alias("script_name"))
    return a.unionByName(steps.select("path", F.lit("workflow-step").alias("tool"), "name", "command", "script_name"))
